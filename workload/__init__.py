"""The engine's operators bound to the driver tables, each with its SQL oracle where one exists."""
