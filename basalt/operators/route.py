"""Routing by event class and the canonical form, as the analysis reads it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.address import canonical
from ..functions.text import fold, hostname, trim
from .contract import ENUMS, enum_name, get, unstorable, violation

#: What the canonical form does to each text; all others stay as they are.
TREATMENT = {
    "origin.host.os": fold,
    "origin.host.architecture": fold,
    "collection.collector": fold,
    "authentication.method": fold,
    "authentication.user.domain": fold,
    "authentication.service.name": fold,
    "authentication.service.protocol": fold,
    "origin.host.hostname": hostname,
    "origin.host.ip": canonical,
    "authentication.network.source.ip": canonical,
    "authentication.network.destination.ip": canonical,
    "authentication.user.name": trim,
    "authentication.user.uid": trim,
}
#: Class number -> route.
ROUTES = {1: "authentication"}


def declared(event_class: Column) -> Column:
    """The enum has this number; 0 counts."""
    return F.coalesce(event_class, F.lit(0)).isin(*ENUMS["event_class"])


def class_name(event_class: Column) -> Column:
    return enum_name(event_class, "event_class", "unspecified", "unknown")


def route(event_class: Column) -> Column:
    out = None
    for number, name in ROUTES.items():
        out = (F if out is None else out).when(event_class == number, name)
    return out


def normalize(event: Column) -> Column:
    """The event in canonical form: each treatment is applied once. A part that is absent stays absent."""

    def rebuilt(c: Column, paths: dict[str, object]) -> Column:
        here: dict[str, object] = {}
        for path, f in paths.items():
            head, _, rest = path.partition(".")
            if rest:
                here.setdefault(head, {})[rest] = f
            else:
                here[head] = f
        out = c
        for name, f in here.items():
            out = out.withField(name, rebuilt(c[name], f) if isinstance(f, dict) else f(c[name]))
        return F.when(c.isNotNull(), out)

    return rebuilt(event, TREATMENT)


def rewritten(before: Column, after: Column) -> Column:
    """Some text was changed by the canonical form."""
    out = F.lit(False)
    for path in TREATMENT:
        out = out | ~get(before, path).eqNullSafe(get(after, path))
    return out


def classify_for_store(df: DataFrame, event: str = "event", undecodable: Column | None = None) -> DataFrame:
    """df with outcome (row, undecodable, contract_violation, unstorable) and detail, as the writer decides."""
    bad = F.lit(False) if undecodable is None else undecodable
    df = df.withColumn("violation", F.when(~bad, violation(F.col(event)))).withColumn("_unstorable", unstorable(F.col(event)))
    outcome = F.when(bad, "undecodable").when(F.col("violation").isNotNull(), "contract_violation").when(F.col("_unstorable").isNotNull(), "unstorable").otherwise("row")
    detail = F.when(F.col("violation").isNotNull(), F.concat_ws(" ", "violation.field", "violation.reason")).when(~bad, F.col("_unstorable"))
    return df.withColumn("outcome", outcome).withColumn("detail", detail).drop("_unstorable", "violation")


def classify_for_analysis(df: DataFrame, event: str = "event", undecodable: Column | None = None) -> DataFrame:
    """df with outcome (analysed, undecodable, unrouted, contract_violation), class and route, as the analysis decides.

    An undeclared class is unrouted before the contract is looked at; the writer, in contrast, refuses it.
    """
    bad = F.lit(False) if undecodable is None else undecodable
    number = F.col(event)["event_class"]
    df = df.withColumn("violation", F.when(~bad & declared(number), violation(F.col(event))))
    outcome = F.when(bad, "undecodable").when(~declared(number), "unrouted").when(F.col("violation").isNotNull(), "contract_violation").otherwise("analysed")
    return df.withColumn("outcome", outcome).withColumn("class", class_name(number)).withColumn("route", F.when(outcome == "analysed", route(number)))


def analyse(df: DataFrame, event: str = "event", undecodable: Column | None = None) -> DataFrame:
    """classify_for_analysis(), with the canonical event of analysed rows and whether it differs."""
    out = classify_for_analysis(df, event, undecodable)
    out = out.withColumn("canonical", F.when(F.col("outcome") == "analysed", normalize(F.col(event))))
    return out.withColumn("rewritten", F.when(F.col("outcome") == "analysed", rewritten(F.col(event), F.col("canonical"))))
