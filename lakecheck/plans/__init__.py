"""The jobs a user runs, composed of operators."""
