"""Where entries come from: text logs (in line order) or any table."""

from .balance import spread
from .table import entries_from_table, lines_from_text_column
from .text import LINE_ORDER, SPLIT_CHUNK, read_log_lines

__all__ = [
    "spread","read_log_lines", "LINE_ORDER", "SPLIT_CHUNK", "entries_from_table", "lines_from_text_column"]
