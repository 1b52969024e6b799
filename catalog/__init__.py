"""The queries registered for checking, their inputs and their SQL twins."""
