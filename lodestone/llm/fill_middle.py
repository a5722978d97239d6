"""Fill-in-the-middle: a text is cut at two token ends, and its middle moves to the back.

A pre-tokenizer of the tokenizers library (``Split``, isolated matches) gives the tokens' ends in
code points; nothing is trained. Their number is the number of tokens, and a slice up to the k-th
token ends at the k-th of them. A long text is tokenised a stretch at a time, cut where a
word is followed by a space, which no token spans; so memory holds one stretch's tokens and one
number per token. All choices come from a hash of seed and key, so any task makes them again alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from lodestone.llm._common import SPACE_CLASS, WORD_CLASS, fresh, trimmed

PATTERN = f"{SPACE_CLASS}*{WORD_CLASS}+|{SPACE_CLASS}+"
SENTINELS = ("<P>", "<S>", "<M>")
#: Code points of a stretch.
STRETCH = 1 << 18
_BREAK = regex.compile(f"{WORD_CLASS}(?={SPACE_CLASS})").search


class Splitter:
    """Ends of the tokens of a text, in code points."""

    def __init__(self):
        self.split = pre_tokenizers.Split(Regex(PATTERN), "isolated")

    def ends(self, text: str, stretch: int = STRETCH) -> np.ndarray:
        parts, at = [], 0
        while at < len(text):
            found = _BREAK(text, at + stretch) if at + stretch < len(text) else None
            to = found.end() if found else len(text)
            parts.append(at + np.array([end for _, (_, end) in self.split.pre_tokenize_str(text[at:to])], np.int64))
            at = to
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """A sentinel must start with a character that stands nowhere else in any, so that none can arise where parts meet."""
    if any(not s or sum(t.count(s[0]) for t in sentinels) != sum(t[0] == s[0] for t in sentinels) for s in sentinels) or len(set(sentinels)) < 3 or any(a != b and b.startswith(a) for a in sentinels for b in sentinels):
        raise ValueError("sentinels must be three different strings, none the start of another, whose first characters stand at their starts only")
    return sentinels


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 42, percent: int = 50, spm_percent: int = 80, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """All rows of ``docs`` plus ``n`` (tokens), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    ``percent`` of the texts are moved, ``spm_percent`` of those with the suffix first (``spm``), the others with the
    prefix first (``psm``). Texts that are empty or hold a sentinel stay as they are (``plain``, null lengths).
    A null text counts as empty and a null key as an empty one; rows of equal key and text come out alike, and an empty
    table stays empty. Columns of these names are replaced, all others are kept."""
    first, then, last = _checked(sentinels)
    docs = docs.drop("n", "form", "prefix_chars", "middle_chars", "output")
    own, drawn = fresh(docs, "__text"), fresh(docs, "__drawn")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    groups = F.array(*(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)))
    spread = docs.withColumns({own: F.coalesce(F.col(text), F.lit("")), drawn: groups})

    def run(batches):
        splitter = Splitter()
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                at, by = batch.schema.get_field_index(own), batch.schema.get_field_index(drawn)
                made: list[tuple] = []
                for t, (h1, h2, h3, h4) in zip(batch.column(at).to_pylist(), batch.column(by).to_pylist(), strict=True):
                    ends = splitter.ends(t)
                    n = len(ends)
                    if not t or h3 % 100 >= percent or any(s in t for s in sentinels):
                        made.append((n, "plain", None, None, t))
                        continue
                    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
                    p, m = (int(ends[k - 1]) if k else 0 for k in (one, two))
                    prefix, middle, suffix = t[:p], t[p:m], t[m:]
                    if h4 % 100 < spm_percent:
                        made.append((n, "spm", p, m - p, f"{then}{suffix}{first}{prefix}{last}{middle}"))
                    else:
                        made.append((n, "psm", p, m - p, f"{first}{prefix}{then}{suffix}{last}{middle}"))
                kept = [i for i in range(batch.num_columns) if i not in (at, by)]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                new = [pa.array([row[i] for row in made], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *new], names=[*(batch.schema.names[i] for i in kept), "n", "form", "prefix_chars", "middle_chars", "output"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields)
    return spread.mapInArrow(trimmed(run), f"{fields}n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of that form was made of; null where either is null."""
    first, then, last = _checked(sentinels)

    def parts(*marks: str) -> list[Column]:
        rest, found = F.substring(output, F.lit(len(marks[0]) + 1), F.length(output)), []
        for mark in marks[1:]:
            part = F.substring_index(rest, mark, 1)
            found.append(part)
            rest = F.substring(rest, F.length(part) + F.lit(len(mark) + 1), F.length(output))
        return [*found, rest]

    prefix, suffix, middle = parts(first, then, last)
    suffix2, prefix2, middle2 = parts(then, first, last)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2))
