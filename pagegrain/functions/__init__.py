"""Column functions: text rules, page ids, references and display forms."""
