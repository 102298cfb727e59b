"""The engine's inputs are bounded files; there are no stream operators, and none are invented here."""
