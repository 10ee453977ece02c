"""Vocabulary shared by every operator."""

# The position of a symbol in this string is its class id.
SYMBOLS = ".PNBRQKpnbrqk"
CLASSES = ("empty", *SYMBOLS[1:])
N_CLASSES = len(CLASSES)
CELLS = 64
FAILED = -1  # class id of a cell whose board could not be processed
FAILED_SYMBOL = "?"
# Square colours, partitions and views.
BACKGROUNDS = ("light", "dark")
SPLITS = ("training", "validation", "evaluation")
WHITE, BLACK = "white-bottom", "black-bottom"
FILES = "abcdefgh"

# Position categories and the mark kinds of annotated boards.
CATEGORIES = ("opening", "middlegame", "endgame", "promotion", "dense", "sparse")
MARK_KINDS = ("last-move", "selection", "check", "circle", "move-dot")

# Result error codes and their transport status.
ERROR_STATUS = {
    "INVALID_REQUEST": 400,
    "PAYLOAD_TOO_LARGE": 413,
    "INVALID_IMAGE": 422,
    "UNSUPPORTED_IMAGE": 422,
    "BOARD_NOT_FOUND": 422,
    "INPUT_READ_ERROR": 500,
    "PROCESSING_FAILED": 500,
}
