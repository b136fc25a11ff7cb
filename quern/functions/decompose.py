"""Compatibility decomposition to ASCII as native expressions: the tables come from Unicode's own data."""

from __future__ import annotations

import functools
import json
import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


@functools.cache
def tables() -> tuple[str, str, dict[str, str]]:
    """Characters that decompose to one ASCII character and those characters, and those that decompose to several."""
    single, bare, several = [], [], {}
    for i in range(0x80, sys.maxunicode + 1):
        c = chr(i)
        if not unicodedata.decomposition(c):
            continue
        left = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if len(left) == 1:
            single.append(c)
            bare.append(left)
        elif left:
            several[c] = left
    return "".join(single), "".join(bare), several


def to_ascii(c: Column) -> Column:
    """The ASCII part of a text's compatibility decomposition: letters without marks, ligatures and numbers spelt out, all else dropped.

    Characters that become one character are one translate step; the few that become several are looked up, in texts that have any.
    """
    single, bare, several = tables()
    known = F.from_json(F.lit(json.dumps(several)), "map<string,string>")  # one literal, and not as many as there are characters

    def spelt(one: Column) -> Column:
        whole = F.array_join(F.transform(F.split(one, ""), lambda x: F.coalesce(F.element_at(known, x), x)), "")
        return F.regexp_replace(F.when(one.rlike("[" + "".join(several) + "]"), whole).otherwise(one), r"[^\x00-\x7F]", "")

    return bound(F.translate(c, single, bare), spelt)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use has it."""
    return F.element_at(F.transform(F.array(value), use), 1)
