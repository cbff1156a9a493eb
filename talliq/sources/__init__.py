"""Sources: transcripts, payloads, the store."""
