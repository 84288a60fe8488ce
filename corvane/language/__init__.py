"""The query language: syntax tree, parser, printer, binder."""
