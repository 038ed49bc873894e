"""Running contractions over streams of rows."""
