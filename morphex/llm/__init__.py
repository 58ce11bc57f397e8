"""Operators that prepare large collections for model training. Optional: nothing else imports this."""
