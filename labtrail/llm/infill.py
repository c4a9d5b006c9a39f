"""Fill-in-the-middle form of texts by one counted-quantifier match a row.

`regexp_count` gives a text's number n of units. Two draws from the document's id name the cuts a <= b, and
the row's own pattern, a possessive `unit{a}`, a possessive `unit{b-a}` and the rest, captures prefix, middle
and suffix in one match, whose replacement writes them in the order of the row's form. All of it are SQL
expressions: rows stay where they are and no text is shuffled.

Forms: `psm` writes prefix, suffix, middle, each behind its marker; `spm` suffix, prefix, middle; `plain` is the
text itself. A text that is empty or contains a marker is plain, so the markers of an output are the only ones
and `restored` rebuilds every text exactly.

Defined cases: a null text is empty; a null id counts as the text `null`; copies of a row have the same cuts.
Whole texts of any length are cut; their units are counted in blocks, so that no array of all units of a long
text is made. Units must not match the empty text; text after the last match of a unit belongs to the suffix.
Other columns are kept; columns named like an added one are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtrail.llm.common import restored as kept_columns
from labtrail.llm.common import whole_row

#: Units that one match of the counting pattern spans.
BLOCK = 4096


@dataclass(frozen=True)
class Infill:
    """Shares are per cent: of all texts that are transformed, and of these that are `spm`."""

    rate: int = 90
    spm: int = 20
    seed: int = 1
    #: one code point
    unit: str = r"(?s:.)"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @property
    def markers(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def order(self, form: str) -> tuple[int, int, int]:
        """Numbers of the captured groups in the order in which a form writes them."""
        return {"psm": (1, 3, 2), "spm": (3, 1, 2)}[form]

    def written(self, form: str) -> str:
        """The replacement that writes a form."""
        mark = {1: self.prefix, 2: self.middle, 3: self.suffix}
        return "".join(re.sub(r"([\\$])", r"\\\1", mark[k]) + f"${k}" for k in self.order(form))


def draws(doc_id: Column, seed: int, count: int) -> list[Column]:
    """The first groups of eight hex digits of sha256(`seed:doc_id`), as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(count)]


def units(text: Column, unit: str) -> Column:
    """Number of units: whole blocks of them, and those that are left behind the last block."""
    block = f"(?:{unit}){{{BLOCK}}}+"
    left = F.regexp_replace(text, F.lit(rf"\A(?:{block})*+"), F.lit(""))
    return (F.regexp_count(text, F.lit(block)).cast("long") * BLOCK + F.regexp_count(left, F.lit(f"(?:{unit})"))).cast("long")


def transformed(docs: DataFrame, config: Infill = Infill(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of `docs` with `n`, `form`, `prefix_chars`, `middle_chars` (units) and `output`."""
    rows = whole_row(docs, F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    h1, h2, h3, h4 = draws(F.col("_id"), config.seed, 4)
    rows = rows.withColumns({"n": units(F.col("_text"), config.unit), "_h1": h1, "_h2": h2, "_h3": h3, "_h4": h4})
    marked = F.lit(False)
    for marker in config.markers:
        marked = marked | F.contains("_text", F.lit(marker))
    plain = (F.col("_text") == "") | marked | (F.col("_h3") % 100 >= config.rate)
    rows = rows.withColumns(
        {
            "form": F.when(plain, "plain").when(F.col("_h4") % 100 < config.spm, "spm").otherwise("psm"),
            "_a": F.least(F.col("_h1") % (F.col("n") + 1), F.col("_h2") % (F.col("n") + 1)),
            "_b": F.greatest(F.col("_h1") % (F.col("n") + 1), F.col("_h2") % (F.col("n") + 1)),
        }
    )
    cut = F.col("form") != "plain"
    rows = rows.withColumns({"prefix_chars": F.when(cut, F.col("_a")), "middle_chars": F.when(cut, F.col("_b") - F.col("_a"))})
    pattern = F.concat(
        F.lit(rf"\A((?:{config.unit}){{"), F.col("prefix_chars").cast("string"), F.lit(rf"}}+)((?:{config.unit}){{"),
        F.col("middle_chars").cast("string"), F.lit(r"}+)((?s:.)*+)\z"),
    )
    replacement = F.when(F.col("form") == "psm", config.written("psm")).otherwise(config.written("spm"))
    output = F.when(cut, F.regexp_replace("_text", pattern, replacement)).otherwise(F.col("_text"))
    rows = rows.withColumn("output", output)
    return rows.select(*kept_columns(rows, "n", "form", "prefix_chars", "middle_chars", "output"))


def restored(output: Column, form: Column, config: Infill = Infill()) -> Column:
    """The text of an output: what stands between the markers, in the order of the text."""
    # an output has each marker once, so it falls into four parts, the first one empty
    parts = F.split(output, "|".join(re.escape(x) for x in config.markers), -1)

    def joined(name: str) -> Column:
        place = {group: k + 1 for k, group in enumerate(config.order(name))}
        return F.concat(*[F.get(parts, F.lit(place[group])) for group in (1, 2, 3)])

    return F.when(form == "psm", joined("psm")).when(form == "spm", joined("spm")).otherwise(output)
