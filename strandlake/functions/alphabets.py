"""Alphabets, character codes and substitution scores."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The IUPAC letters, and the characters that mean a gap.
PROTEIN = "ACDEFGHIKLMNPQRSTVWY"
EXTENDED_PROTEIN = "ACDEFGHIKLMNPQRSTVWYBXZJUO"
DNA = "ACGT"
EXTENDED_DNA = "ACGTRYWSMKHBVDN"
GAPS = "-.*"

POLYMERS = {"Protein": EXTENDED_PROTEIN, "DNA": EXTENDED_DNA}


def letters_of(polymer: str) -> str:
    if polymer not in POLYMERS:
        raise ValueError(f"polymer type must be one of {sorted(POLYMERS)}, not {polymer!r}")
    return POLYMERS[polymer]


def multi_position(letters: str | list[str], size: int) -> list[str]:
    """All words of ``size`` letters, in order."""
    if size < 1:
        raise ValueError("size must be 1 or more")
    return ["".join(p) for p in product(letters, repeat=size)]


def mapping(letters: str | list[str], skip: str | list[str] = ()) -> dict[str, int]:
    """Letter -> code; gaps (as wide as a letter) get the next code, skipped letters the one after."""
    kept = [x for x in letters if x not in skip]
    width = len(kept[0])
    out = {x: k for k, x in enumerate(kept)}
    out |= {g * width: len(kept) for g in GAPS if g * width not in out}
    out |= {x: len(kept) + 1 for x in skip}
    return out


def reverse(codes: dict[str, int]) -> list[str]:
    """Code -> letter; of the gap characters the first one."""
    out: dict[int, str] = {}
    for letter, code in codes.items():
        out.setdefault(code, letter)
    return [out[k] for k in sorted(out)]


def encoded(seq: Column, codes: dict[str, int]) -> Column:
    """array<int> of the codes of a sequence; an unknown character raises an error."""
    table = F.create_map(*[x for k, v in codes.items() for x in (F.lit(k), F.lit(v))])
    letters = F.filter(F.split(seq, ""), lambda c: c != "")
    return F.transform(letters, lambda c: F.coalesce(table[c], F.raise_error(F.concat(F.lit("unknown character "), c)).cast("int")))


def parse_substitution_matrix(text: str) -> dict[tuple[str, str], float]:
    """Scores of a matrix in the common text form: comments, a header of letters, a row for each letter."""
    rows = [line.split() for line in text.splitlines() if line.strip() and not line.startswith("#")]
    header = rows[0]
    return {(r[0], h): float(v) for r in rows[1:] for h, v in zip(header, r[1:], strict=True)}


def identity_matrix(letters: str) -> dict[tuple[str, str], float]:
    return {(a, b): float(a == b) for a in letters for b in letters}
