"""The engine's queries over the tables of a data folder, each with its SQL where SQL can express it."""
