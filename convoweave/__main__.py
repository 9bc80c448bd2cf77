"""Command line: python -m convoweave ARCHIVE index ROOT ADAPTER | search TEXT | related ID | session ID | recent | sessions | stats | export DIR | import DIR | reconcile | map."""

from __future__ import annotations

import argparse

from convoweave.archive import ADAPTERS, Archive
from convoweave.session import get_session


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="convoweave", description="An archive of conversations on Spark.")
    parser.add_argument("archive")
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index")
    index.add_argument("root")
    index.add_argument("adapter", choices=sorted(ADAPTERS))
    find = commands.add_parser("search")
    find.add_argument("text")
    for name in ("mode", "session", "since", "until"):
        find.add_argument(f"--{name}", default="hybrid" if name == "mode" else None)
    find.add_argument("-k", type=int, default=5)
    for name, argument in (("related", "id"), ("session", "id"), ("export", "dir"), ("import", "dir")):
        commands.add_parser(name).add_argument(argument)
    for name in ("recent", "sessions", "stats", "reconcile", "map"):
        commands.add_parser(name)
    a = parser.parse_args(arguments)
    archive = Archive(get_session(), a.archive)
    if a.command == "index":
        print(archive.index(a.root, a.adapter))
    elif a.command == "search":
        archive.search(a.text, a.k, a.mode, a.session, a.since, a.until).show(truncate=80)
    elif a.command == "export":
        archive.export(a.dir)
    elif a.command == "import":
        print(archive.import_from(a.dir))
    elif a.command == "map":
        archive.build_map()
        archive.table("clusters").drop("centroid").orderBy("cluster").show(truncate=80)
    elif a.command == "reconcile":
        print(archive.reconcile())
    else:
        shown = {"related": lambda: archive.related(a.id), "session": lambda: archive.session(a.id), "recent": archive.recent, "sessions": archive.sessions, "stats": archive.stats}
        shown[a.command]().show(truncate=80)


if __name__ == "__main__":
    main()
