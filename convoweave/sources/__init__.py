"""Reading transcripts and snapshots, and writing archives."""
