"""Detection and redaction put together. All of it happens inside a row: no shuffle, batch or stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushspan.functions.entities import SPANS
from hushspan.functions.rules import GIVEN_NAMES, RULES, Rule
from hushspan.operators import detect as d
from hushspan.operators.gate import gate
from hushspan.operators.redact import redacted
from hushspan.operators.resolve import resolve

Layer = Callable[[Column], Column]


class Pipeline:
    """Layers in their fixed order, an optional list of a user's rules, an optional column of a model's findings.

    layers: those to run, by name; more: layers of the caller's own, run after them. on_error: "raise" ends the job when
    a user's rule runs over its time; "null" leaves redacted_text and spans null for that row and names the rules in
    column error. Texts never appear in errors.
    """

    NAMES = ("data", "regex", "delimited", "json", "names", "common")

    def __init__(self, layers: Sequence[str] = NAMES, rules: Sequence[Rule] = RULES, user_rules: Sequence[dict] = (), given_names: Sequence[str] = GIVEN_NAMES, findings: str | None = None, more: Sequence[Layer] = (), on_error: str = "raise"):
        if unknown := set(layers) - set(self.NAMES):
            raise ValueError(f"unknown layers: {sorted(unknown)}")
        known: dict[str, Layer] = {
            "data": d.data_spans,
            "regex": lambda t: d.regex_spans(t, rules),
            "delimited": d.delimited_spans,
            "json": d.json_spans,
            "names": lambda t: d.name_spans(t, given_names),
            "common": lambda t: d.common_name_spans(t, given_names),
        }
        #: Those in Spark's own functions, and those that hand some texts to Python and take a step of their own.
        self.layers = [known[n] for n in self.NAMES if n in layers and n not in ("delimited", "json")] + list(more)
        self.structured = [known[n] for n in ("delimited", "json") if n in layers]
        self.user_rules, self.rejected = d.usable(user_rules)
        self.names, self.findings, self.on_error = given_names, findings, on_error
        if not self.layers and not self.structured and not self.user_rules:
            raise ValueError("no detector is left: that nothing is found would mean nothing")

    def detect(self, df: DataFrame) -> DataFrame:
        """df (text) with spans, disjoint and ascending; with user rules also error, null where all went well. Empty and null
        texts have none. Columns of df with these names are refused."""
        self._free(df, ["spans", *(["error"] if self.user_rules else [])])
        text = F.col("text")
        parts = [layer(text) for layer in self.layers]
        own = df
        for i, layer in enumerate(self.structured):
            own = own.withColumn(f"_py{i}", layer(text))
            parts.append(F.col(f"_py{i}"))
        none = F.array().cast(SPANS)
        own = own.withColumn("_found", F.when(F.length(text) > 0, F.concat(*parts)).otherwise(none) if parts else none)
        own = own.drop(*[f"_py{i}" for i in range(len(self.structured))])
        error = F.lit(None).cast("string")
        if self.user_rules:
            own = own.withColumn("_user", d.user_spans(text, self.user_rules))
            late = F.size("_user.timed_out") > 0
            error = F.when(late, F.concat(F.lit("rules over their time: "), F.array_join("_user.timed_out", ", ")))
            own = own.withColumn("_found", F.concat("_found", "_user.spans"))
        if self.findings:
            own = own.withColumn("_model", gate(F.col(self.findings), F.col("_found"), text, self.names))
            own = own.withColumn("_found", F.concat("_found", "_model")).drop("_model")
        own = resolve(own.withColumn("error", error).drop("_user") if self.user_rules else own, "_found")
        if self.on_error == "raise" and self.user_rules:
            own = own.withColumn("spans", F.when(F.col("error").isNull(), F.col("spans")).otherwise(F.raise_error(F.col("error"))))
        elif self.user_rules:
            own = own.withColumn("spans", F.when(F.col("error").isNull(), F.col("spans")))
        return own

    def run(self, df: DataFrame, mode: str = "redact", key: bytes | None = None, width: int = 8) -> DataFrame:
        """detect(), with tokens and redacted_text; redacted_text is null where spans are."""
        self._free(df, ["tokens", "redacted_text"])
        return redacted(self.detect(df), mode, key, width)

    @staticmethod
    def _free(df: DataFrame, names: list[str]) -> None:
        if taken := [n for n in names if n in df.columns]:
            raise ValueError(f"columns that would be overwritten: {taken}")


def html_redacted(pages: DataFrame, pipeline: Pipeline, column: str = "html") -> DataFrame:
    """pages with redacted_text of their plain text."""
    from hushspan.sources.files import html_text

    return pipeline.run(pages.withColumn("text", html_text(F.col(column))))


