"""Named queries: what each operator answers over the project's tables."""
