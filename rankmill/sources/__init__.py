"""Reading and writing: tables, staged text, pages, logs, versioned state."""
