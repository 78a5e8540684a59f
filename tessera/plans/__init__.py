"""The front end: text to tokens, statements and typed expressions."""
