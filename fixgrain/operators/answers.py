"""Prompts for a model, and its answers checked against their domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import all_matches, matches, unfenced

#: Most characters of each text in a prompt, by purpose.
CAPS = {
    "fix": {"title": 200, "description": 600, "diff": 2800},
    "label": {"title": 200, "description": 900, "diff": 3000},
    "threat": {"title": 10**6, "description": 2000, "diff": 0},
}


def subsystems(*texts: Column, most: int = 6) -> Column:
    """The first distinct sensitive names in the texts, in order of name, separated by a comma."""
    found = F.transform(all_matches(F.concat_ws(" ", *(F.coalesce(t, F.lit("")) for t in texts)), fixed.SUBSYSTEM), F.lower)
    return F.array_join(F.slice(F.array_sort(F.array_distinct(found)), 1, most), ", ")


def prompt(template: str, purpose: str, **texts: Column) -> Column:
    """The template with each ``{name}`` replaced by its text, cut to the purpose's cap; null texts are empty."""
    out = F.lit(template)
    for name, text in texts.items():
        cut = F.substring(F.coalesce(text, F.lit("")), 1, CAPS[purpose].get(name, 10**6))
        out = F.replace(out, F.lit("{" + name + "}"), cut)
    return out


def threat_answer(answer: Column) -> Column:
    """Struct (stride, cwe_top25) of an answer, fenced or not; values outside of their domains are Other and N/A."""
    got = F.from_json(unfenced(answer), "stride string, cwe_top25 string")
    stride = F.when(got["stride"].isin(*fixed.STRIDE), got["stride"]).otherwise("Other")
    cwe = F.when(got["cwe_top25"].isin(*fixed.CWE_TOP), got["cwe_top25"]).otherwise("N/A")
    return F.struct(stride.alias("stride"), cwe.alias("cwe_top25"))


def threat_back(findings: DataFrame, answers: DataFrame) -> DataFrame:
    """Findings with the stride and cwe of their id's answer, Other and N/A without one. Answers have (id, answer), one row an id."""
    own = answers.select("id", threat_answer(F.col("answer")).alias("_a"))
    rows = findings.drop("stride", "cwe_top25").join(own, "id", "left")
    return rows.select("*", F.coalesce("_a.stride", F.lit("Other")).alias("stride"), F.coalesce("_a.cwe_top25", F.lit("N/A")).alias("cwe_top25")).drop("_a")


def label_domain(layer: Column) -> Column:
    """The areas that a finding of a layer may have."""
    common = tuple(dict.fromkeys(name for _, name in fixed.COMMON_AREAS)) + ("other",)
    own = {k: tuple(dict.fromkeys(name for _, name in rules)) for k, rules in (("consensus", fixed.CONSENSUS_AREAS), ("execution", fixed.EXECUTION_AREAS))}
    return F.when(layer == "consensus", F.array(*map(F.lit, own["consensus"] + common))).otherwise(F.array(*map(F.lit, own["execution"] + common)))


def label_answer(answer: Column, layer: Column) -> Column:
    """Struct (label, root_cause, attack_path, cwe) of an answer: only areas of the layer, any cause and path, and ids as CWE-n; else null."""
    flat = F.regexp_extract(answer, r'\{[^{}]*"label"[^{}]*\}', 0)
    got = F.from_json(flat, "label string, root_cause string, attack_path string, cwe string")
    return F.struct(
        F.when(F.array_contains(label_domain(layer), got["label"]), got["label"]).alias("label"),
        F.nullif(got["root_cause"], F.lit("")).alias("root_cause"),
        F.nullif(got["attack_path"], F.lit("")).alias("attack_path"),
        F.when(matches(F.coalesce(got["cwe"], F.lit("")), r"^CWE-\d+$"), got["cwe"]).alias("cwe"),
    )


def label_targets(labels: DataFrame) -> DataFrame:
    """Label rows that a model should look at: those without an area or without a commit."""
    return labels.where((F.coalesce("label", F.lit("other")) == "other") | (F.coalesce("fix_commit", F.lit("")) == ""))


def merge_labels(labels: DataFrame, answers: DataFrame) -> DataFrame:
    """Labels with the accepted parts of the answers of label_targets put over them. Answers have (id, answer), one row an id."""
    todo = label_targets(labels).select("id", "layer").join(answers.select("id", "answer"), "id")
    own = todo.select("id", label_answer(F.col("answer"), F.col("layer")).alias("_a"))
    names = {"label": "label", "root_cause": "root_cause", "attack_path": "attack_path", "cwe": "cwe_top25"}
    rows = labels.join(own, "id", "left")
    return rows.withColumns({to: F.coalesce(F.col(f"_a.{part}"), F.col(to)) for part, to in names.items()}).drop("_a")


def fix_probability(predictions: DataFrame) -> DataFrame:
    """(source_url, silent_fix_prob, is_security_fix, vuln_class, reason) of answers with a verdict.

    The probability is the confidence of a yes and one less that of a no, to three digits.
    """
    sure = F.coalesce("confidence", F.lit(0.0))
    return predictions.where("is_security_fix is not null").select(
        "source_url",
        F.round(F.when(F.col("is_security_fix"), sure).otherwise(1 - sure), 3).alias("silent_fix_prob"),
        F.col("is_security_fix").cast("int").alias("is_security_fix"),
        F.coalesce("vuln_class", F.lit("")).alias("vuln_class"),
        F.substring(F.coalesce("reason", F.lit("")), 1, 200).alias("reason"),
    )
