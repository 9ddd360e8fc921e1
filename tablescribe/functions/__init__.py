from .keys import order_key
from .text import cap_block, cap_prompt, csv_field, tokenize

__all__ = ["order_key", "cap_block", "cap_prompt", "csv_field", "tokenize"]
