"""The five marker characters of rendered conversations, and the base character set."""

# The markers' code points and the characters that every vocabulary has.
START, USER, BOT, END, THINK = "◈", "▶", "◀", "■", "◇"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WHITE = " \t\n"
MARKERS = START + USER + BOT + END + THINK
BASE = LETTERS + DIGITS + PUNCTUATION + WHITE + MARKERS
