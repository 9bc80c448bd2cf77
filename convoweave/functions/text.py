"""Text columns of turns: what is embedded, indexed, compared and left out."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Questions that say nothing by themselves.
TRIVIAL = ("ok", "okay", "ㅇㅇ", "ㅇ", "응", "넵", "네", "예", "고마워", "고맙습니다", "감사", "감사합니다", "ㄱㅅ", "thanks", "thx", "yes", "no", "y", "n")
LEAST_CHARS = 15
TOKEN = r"[\p{L}\p{N}]+"
COMPAT_TOKEN = r"[A-Za-z0-9]+|[가-힣]+"


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column, chars: int | None = None) -> Column:
    """White space as single spaces, trimmed, at most `chars` characters."""
    out = strip(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.substring(out, 1, chars) if chars else out


def filled(text: Column) -> Column:
    """Null where the text is empty."""
    return F.when(text != "", text)


def rendered(actions: Column) -> Column:
    """Each action as tool(detail), or tool alone."""
    return F.transform(actions, lambda a: F.when(a["detail"] != "", F.concat(a["tool"], F.lit("("), a["detail"], F.lit(")"))).otherwise(a["tool"]))


def embed_text(question: Column, answer: Column, actions: Column) -> Column:
    """`Q: ...`, `A: ...` and `[actions] a; b` on lines; empty parts are left out."""
    q = F.when(question != "", F.concat(F.lit("Q: "), question))
    a = F.when(answer != "", F.concat(F.lit("A: "), answer))
    acts = F.when(F.size(actions) > 0, F.concat(F.lit("[actions] "), F.array_join(rendered(actions), "; ")))
    return F.concat_ws("\n", q, a, acts)


def keyword_text(question: Column, answer: Column, actions: Column) -> Column:
    """The text of the keyword index: question, answer and actions on lines, empty ones too."""
    return F.concat(question, F.lit("\n"), answer, F.lit("\n"), F.array_join(rendered(actions), " "))


def worth_embedding(question: Column, answer: Column, actions: Column) -> Column:
    """False for trivial questions with short answers and for turns with hardly any text; turns with actions stay."""
    q, a = strip(question), strip(answer)
    trivial = F.lower(q).isin(*TRIVIAL) & (F.char_length(a) < LEAST_CHARS)
    short = F.char_length(q) + F.char_length(a) < LEAST_CHARS
    return (F.size(actions) > 0) | ~(trivial | short)


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), 1)


def question_key(question: Column) -> Column:
    """What near-equal questions share: lower case, white space squeezed."""
    return squeeze(F.lower(question))


def contextual(project: Column, previous: Column, text: Column) -> Column:
    """A chunk behind its project and the first 120 characters of the question before."""
    tag = F.when(project != "", F.concat(F.lit("["), project, F.lit("]")))
    before = F.when(previous != "", F.concat(F.lit("이전: "), F.substring(previous, 1, 120)))
    head = F.concat_ws(" ", tag, before)
    return F.when(head != "", F.concat(head, F.lit("\n"), text)).otherwise(text)


def session_of_path(path: Column) -> Column:
    """The session id in a file name: its UUID, else its stem."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    found = F.regexp_extract(name, r"([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})", 1)
    return F.when(found != "", found).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))


def source_or_default(source: Column, default: str = "claude-code") -> Column:
    return F.coalesce(F.nullif(source, F.lit("")), F.lit(default))
