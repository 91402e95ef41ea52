"""Readers of the text formats, and writers of derived texts and tables."""
