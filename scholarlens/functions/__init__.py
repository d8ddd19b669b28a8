"""Part of scholarlens; see README.md."""
