"""The queries: operators bound to tables, each with its SQL where SQL can say it."""
