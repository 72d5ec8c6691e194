"""Fill-in-the-middle: a text cut in three at token borders and put in another order between marks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import free_name
from tickloom.llm.hashing import frugal

#: A token: a word with the white space before it, or white space at the end of a text.
TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Characters that are split in one go; a longer text is taken in pieces that end where a token ends.
PIECE = 1_000_000
_END = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D])")
_splitters: dict[str, object] = {}


def _splitter(pattern: str):
    """The library's pre-tokenizer, made once a worker; nothing is trained."""
    if pattern not in _splitters:
        from tokenizers import Regex, pre_tokenizers

        _splitters[pattern] = pre_tokenizers.Split(Regex(pattern), "isolated")
    return _splitters[pattern]


def token_ends(text: str, piece: int = PIECE) -> np.ndarray:
    """Code-point offset after each token of a text; an empty text has none."""
    split, at, found = _splitter(TOKEN).pre_tokenize_str, 0, []
    while at < len(text):
        cut = _END.search(text, at + piece - 1) if len(text) - at > piece else None
        stop = cut.end() if cut else len(text)
        found.append(np.array([span[1] for _, span in split(text[at:stop])], np.int64) + at)
        at = stop
    return np.concatenate(found) if found else np.empty(0, np.int64)


def cut_text(text: str, key: str, seed: int, percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, code points of prefix and of middle, output) of one text; the draws hang on seed and key alone."""
    ends = token_ends(text)
    n = len(ends)
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    if not text or any(m in text for m in MARKS) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, z = (int(ends[k - 1]) if k else 0 for k in (first, second))
    p, s, m = MARKS
    prefix, middle, suffix = text[:a], text[a:z], text[z:]
    if h4 % 100 < spm_percent:
        return n, "spm", a, z - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, z - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def restored(output: str | Column, form: str | Column) -> Column:
    """The text that an output of fill_in_middle was made of. No text with a mark of its own is ever cut."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    part = F.split(output, "|".join(MARKS), -1)
    order = lambda *at: F.concat(*[F.get(part, F.lit(i)) for i in at])
    return F.when(form == "psm", order(1, 3, 2)).when(form == "spm", order(2, 3, 1)).otherwise(output)


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """`docs` with a struct column `fim`: n (tokens), form (plain, psm or spm), prefix_chars, middle_chars, output.

    Of all texts about `percent` % are cut, of these `spm_percent` % in the order suffix, prefix, middle and the others prefix,
    suffix, middle. Draws are of the SHA-256 of seed and key, so that runs and repeated rows agree, and rows of one key
    with other texts have the same draws; a null key draws as the empty string. Null and empty texts are plain with an empty output
    and 0 tokens; texts that hold a mark are plain. Whole texts are read however long, PIECE characters at a time. An empty
    table gives no rows. Other columns are carried; one called `fim` is replaced. Rows are independent: nothing is shuffled.
    """
    carried = [c for c in docs.columns if c.lower() != "fim"]
    k, t = free_name(docs, "fim_key"), free_name(docs, "fim_text")
    rows = docs.select(*carried, F.coalesce(F.col(key).cast("string"), F.lit("")).alias(k), F.col(text).alias(t))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*carried).schema)
    names = ("n", "form", "prefix_chars", "middle_chars", "output")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [cut_text(x.as_py() or "", i, seed, percent, spm_percent) for x, i in zip(batch.column(t), batch.column(k).to_pylist())]
            made = [pa.array(c, kind) for c, kind in zip(zip(*found), kinds)] if found else [pa.array([], kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.StructArray.from_arrays(made, names)], [*carried, "fim"])

    kind = "struct<n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output: string>"
    return rows.mapInArrow(frugal(cut), f"{schema}`fim` {kind}")
