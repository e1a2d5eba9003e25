"""From configurations to chains of operators."""
