"""Severity bands and alert texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom.functions.flows import lookup
from flowloom.registry import (
    ADVICE,
    BANDS,
    BENIGN,
    CRITICAL_PREFIX,
    OTHER_ADVICE,
    SEVERITIES,
    TITLES,
)


def _band(risk: Column, names) -> Column:
    chain = reduce(
        lambda chain, item: chain.when(risk <= item[0][1], F.lit(item[1])),
        zip(BANDS[:-1], names),
        F,
    )
    return chain.otherwise(F.lit(names[-1]))


def severity(risk: Column) -> Column:
    return _band(risk, SEVERITIES)


def severity_rank(risk: Column) -> Column:
    """Position of the band: 0 for LOW up to 3 for CRITICAL."""
    return _band(risk, range(len(SEVERITIES)))


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank + 1)


def raises_alert(label: Column, risk: Column, min_risk) -> Column:
    return (label != BENIGN) & (risk >= min_risk)


def percent(share: Column) -> Column:
    """Share as a percentage with one decimal, exact ties to the even digit.

    The fraction of a number in [1, 128) times ten is exact in a double, so rint sees the true
    value; format_string would round the shortest decimal text half up.
    """
    value = share * 100
    tenths = F.floor(value) * 10 + F.rint((value - F.floor(value)) * 10).cast("long")
    whole = F.floor(tenths / 10).cast("long")
    return F.concat(whole.cast("string"), F.lit("."), (tenths - whole * 10).cast("string"), F.lit("%"))


def title(label: Column) -> Column:
    spaced = F.replace(label, F.lit("_"), F.lit(" "))
    plain = F.concat(F.upper(F.substring(spaced, 1, 1)), F.lower(F.substr(spaced, F.lit(2))))
    return F.coalesce(lookup(label, TITLES), plain)


def description(label: Column, confidence: Column, dst: Column, dst_port: Column) -> Column:
    with_port = F.concat(dst, F.lit(":"), dst_port.cast("string"))
    target = F.when(F.coalesce(dst_port, F.lit(0)) != 0, with_port).otherwise(dst)
    return F.concat(
        title(label), F.lit(" detected — confidence "), percent(confidence), F.lit(" — target "), target
    )


def advice(label: Column, band: Column, src: Column, dst: Column) -> Column:
    text = F.coalesce(lookup(label, ADVICE), F.lit(OTHER_ADVICE))
    filled = F.replace(F.replace(text, F.lit("{src}"), src), F.lit("{dst}"), dst)
    return F.when(band == "CRITICAL", F.concat(F.lit(CRITICAL_PREFIX), filled)).otherwise(filled)
