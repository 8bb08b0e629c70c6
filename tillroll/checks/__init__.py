"""The same questions for another SQL engine, and a script that compares the two."""
