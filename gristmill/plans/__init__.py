"""Plans built of operators."""
