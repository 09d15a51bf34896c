"""Value rules of text columns, and the expression language."""
