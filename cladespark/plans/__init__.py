"""The command language, its rewrites and the session that runs it."""
