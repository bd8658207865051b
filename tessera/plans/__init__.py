"""Registered queries: each a function of the session and the data folder, with its SQL beside it."""
