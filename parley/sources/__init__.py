"""Reading transcripts and keeping tables."""
