"""Words of Chinese text by a dictionary: longest match first, in an Arrow function. The dictionary is the caller's."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

from .stopwords import CHINESE

DROPPED = frozenset("ruwxy")
_RUNS = re.compile(r"[一-龥]+|[A-Za-z0-9_]+")


def segment(text: str, dictionary: dict[str, str], longest: int) -> list[tuple[str, str]]:
    """Words and tags. Han characters in no word stand alone, tagged x; runs of Latin letters and digits are words tagged eng."""
    out = []
    for run in _RUNS.findall(text):
        if not "一" <= run[0] <= "龥":
            out.append((run, dictionary.get(run, "eng")))
            continue
        i = 0
        while i < len(run):
            n = next((n for n in range(min(longest, len(run) - i), 1, -1) if run[i : i + n] in dictionary), 1)
            out.append((run[i : i + n], dictionary.get(run[i : i + n], "x")))
            i += n
    return out


def chinese_tokens(dictionary: dict[str, str], stopwords: tuple[str, ...] = CHINESE) -> Callable[[Column], Column]:
    """A tokeniser: words of two characters and more whose tag is not dropped and that aren't stopwords. dictionary: word to tag."""
    longest, stop = max(map(len, dictionary), default=1), frozenset(stopwords)

    def words(t: str | None) -> list[str]:
        return [w for w, tag in segment(t or "", dictionary, longest) if len(w) > 1 and w not in stop and tag not in DROPPED]

    ship(SparkSession.active())

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(words)

    return run
