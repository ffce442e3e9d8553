"""Column functions on document text. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six reserved tokens in id order, the 29 characters Python's str.split() splits
# at, the shortest document kept, the characters that decide a split, and the word pattern of
# byte-level tokenizing.
SPECIALS = ["<|pad|>", "<|eos|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>"]
PAD, EOS, SYSTEM, USER, ASSISTANT, END = range(6)
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_RUN = (
    r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
MIN_CHARS = 100
SPLIT_PREFIX = 4096
HOLDOUT_BUCKETS = 100
WORD_PATTERN = (
    r"(?U)('s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+)"
)


def strip(text: Column) -> Column:
    """Whitespace off both ends; looks at the ends only, never scans the middle."""
    return F.trim(text, F.lit(WHITESPACE))


def collapse(text: Column) -> Column:
    """Every whitespace run becomes one space, none at the ends. Exact for text of any length."""
    return F.trim(F.regexp_replace(text, WHITESPACE_RUN, " "))


def collapse_prefix(text: Column) -> Column:
    """:func:`collapse` of the first ``SPLIT_PREFIX`` code points, several times cheaper.

    This runs on every document, and a regular expression over the prefix would cost more than all
    other column work together. Plain byte searches settle the usual case: only spaces, tabs and
    line ends. Halving double spaces 12 times is enough for runs of ``SPLIT_PREFIX`` = 2**12.
    """

    def squeeze(flat: Column) -> Column:
        single = flat
        for _ in range(SPLIT_PREFIX.bit_length() - 1):
            single = F.replace(single, F.lit("  "), F.lit(" "))
        return F.trim(F.when(F.contains(flat, F.lit("  ")), single).otherwise(flat))

    def settle(head: Column) -> Column:
        rare = F.lit(False)
        for c in WHITESPACE:
            if c not in " \t\n\r":
                rare = rare | F.contains(head, F.lit(c))
        flat = head
        for c in "\n\t\r":
            flat = F.replace(flat, F.lit(c), F.lit(" "))
        return F.when(rare, collapse(head)).otherwise(_once(flat, squeeze))

    return _once(F.substring(text, 1, SPLIT_PREFIX), settle)


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_long_enough(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """True for text whose stripped length reaches ``min_chars`` code points; never null."""
    # octet_length is free and bounds the code points, so short rows skip the trim.
    return F.coalesce(
        (F.octet_length(text) >= min_chars) & (F.length(strip(text)) >= min_chars), F.lit(False)
    )


def is_blank(text: Column) -> Column:
    """True for null, empty or all-whitespace text."""
    return F.coalesce(F.length(strip(text)) == 0, F.lit(True))


def neutralize(text: Column) -> Column:
    """Break reserved tokens that occur in the text itself, so none can encode to a control id."""
    broken = F.regexp_replace(
        text, r"<(\|(?:pad|eos|system|user|assistant|end)\|>)", "< $1"
    )
    return F.when(F.contains(text, F.lit("<|")), broken).otherwise(text)


def split_key(text: Column) -> Column:
    """What the hold-out hash looks at: a bounded prefix with whitespace collapsed."""
    return collapse_prefix(text)


def holdout_bucket(text: Column) -> Column:
    """First 8 bytes of the key's SHA-256, big-endian, modulo 100.

    ``conv`` gives the unsigned decimal digits; modulo 100 is the last two of them.
    """
    head = F.substring(F.sha2(split_key(text), 256), 1, 16)
    return F.substring(F.conv(head, 16, 10), -2, 2).cast("int")


def split_of(text: Column) -> Column:
    """``val`` for bucket 0, else ``train``."""
    return F.when(holdout_bucket(text) == 0, F.lit("val")).otherwise(F.lit("train"))


def words(text: Column) -> Column:
    """Pre-tokenized words as ``array<string>``; their concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(1))


def latin1(text: Column) -> Column:
    """A string with one character per UTF-8 byte."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def byte_symbol_ids() -> list[int]:
    """Token id of each byte value.

    Printable bytes keep their own code point in the byte alphabet, the rest are numbered from 256
    up in byte order. Ids follow the code points, after the reserved tokens.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    ids = [0] * 256
    for rank, byte in enumerate(printable + rest):
        ids[byte] = len(SPECIALS) + rank
    return ids


def byte_alphabet() -> list[str]:
    """The printable symbol that stands for each byte value in vocabulary files."""
    ids = byte_symbol_ids()
    kept = 256 - sum(1 for b in range(256) if _is_remapped(b))
    first_remapped = len(SPECIALS) + kept
    return [
        chr(256 + ids[b] - first_remapped) if _is_remapped(b) else chr(b) for b in range(256)
    ]


def _is_remapped(byte: int) -> bool:
    return byte < 33 or 127 <= byte < 161 or byte == 173


def byte_ids(text: Column) -> Column:
    """Ids of the merge-free byte tokenizer as ``array<int>``."""
    table = F.lit(byte_symbol_ids())
    chars = F.split(latin1(text), "")
    ids = F.transform(chars, lambda c: F.get(table, F.ascii(c)))
    return F.when(F.octet_length(text) == 0, F.array().cast("array<int>")).otherwise(ids)


def byte_count(text: Column) -> Column:
    """How many ids :func:`byte_ids` gives, without building them."""
    return F.octet_length(text).cast("bigint")


def with_eos(ids: Column) -> Column:
    return F.concat(ids, F.array(F.lit(EOS)))


def decode_ids(ids: Column, symbols: list[bytes]) -> Column:
    """Text of an id array. ``symbols[id]`` holds the bytes of each id; reserved ids hold none.

    The list has at most 65,536 entries (ids are 16 bits wide), so it travels as a literal.
    """
    table = F.lit([s.hex() for s in symbols])
    hexes = F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")
    return F.make_valid_utf8(F.unhex(hexes).cast("string"))


def byte_symbols() -> list[bytes]:
    """``symbols`` of the byte tokenizer for :func:`decode_ids`."""
    out = [b""] * (len(SPECIALS) + 256)
    for byte, token in enumerate(byte_symbol_ids()):
        out[token] = bytes([byte])
    return out
