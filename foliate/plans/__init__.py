"""Plans written as Markdown tables, as relational tables."""
