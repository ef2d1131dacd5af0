"""Reports of the stages as Markdown: a title, how the data came about, what each table holds, the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from riskloom.operators.synthesis import markdown
from riskloom.operators.verdicts import PROHIBITED_CLAIMS

MODES = {
    "real": "Scores were computed from recordings.",
    "simulation": "SIMULATED: scores were drawn at random. Nothing here says anything about patients.",
    "unverified": "UNVERIFIED: the table of predictions has no manifest that matches it.",
}
#: Stage: title, and a line for each table that may occur.
SECTIONS = {
    "inventory": ("Inventory", {"linkage": "How many recordings, subjects and encounters there are and how they link."}),
    "cohort": ("Cohort and outcomes", {
        "flow": "Recordings and subjects left after each step.", "outcomes": "Valid recordings, deaths and rates by horizon.", "splits": "Recordings, subjects and events of each split; no subject is in two.",
    }),
    "probe": ("Continuous predictions", {
        "probe": "The penalty chosen on val and the validation log-loss of each that was tried.", "validity": "Rows that each model scored.", "predictions": "Scores of A and B by split, and how well B tells and predicts.",
    }),
    "analyze": ("Primary results", {
        "discrimination": "AUROC and AUPRC of B on the test split.", "proper_scores": "Log-loss and Brier score of B.", "correlations": "Agreement of A and B by value and by rank.", "comparison": "Gains of B over A; above zero B is better.",
        "stratified_risk": "Risk by category of A.", "tertiles": "Risk by thirds of B within each category of A.", "discordance": "Quadrants of A and B.", "risk_contrasts": "Differences and ratios of risk between quadrants.",
        "nested": "Models of A, of B and of both, fitted on dev.", "gains": "What both gain over A on the test split.", "decision_curves": "Net benefit of A, B, both and of treating all, by threshold.",
        "smoother": "What B is expected to be at a score of A.", "risk_surface": "Risk by fifths of both scores.", "calibration": "Slope and intercept of the outcome on the log odds of B.", "deciles": "Observed and predicted risk by tenths of B.",
    }),
    "sensitivity": ("Sensitivity analyses", {
        "horizons": "A, B and B - A by horizon.", "anchoring": "By how the index recording was chosen.", "subgroups": "By age and sex; groups under five subjects are left out.", "subgroup_contrasts": "How the gain of B over A differs between two groups.", "probe_variants": "Probes with other penalties.",
        "quality": "All recordings and those of good quality.", "alternative_scores": "Other rule scores.", "second_embedding": "A probe on another encoder.", "directions": "How many differences favour B.",
    }),
    "interpret": ("Interpretation", {
        "failures": "Recordings that a model couldn't score.", "findings": "Findings and verdicts.", "utility": "What a gain shows and what it leaves open.",
    }),
}


def claims_in(text: str) -> list[str]:
    low = text.lower()
    return [p for p in PROHIBITED_CLAIMS if p in low]


def render(stage: str, mode: str | None, tables: dict[str, DataFrame]) -> str:
    """A stage's report. A text that makes a prohibited claim is an error."""
    title, notes = SECTIONS.get(stage, (stage, {}))
    lines = [] if mode is None else [MODES.get(mode, f"Mode: {mode}."), ""]
    body = markdown(f"{stage}: {title}", tables).split("\n")
    out = body[:2] + lines
    for line in body[2:]:
        out.append(line)
        name = line[3:]
        note = notes.get(name) or notes.get(name.removesuffix("_intervals"))
        if line.startswith("## ") and note:
            out += ["", note]
    text = "\n".join(out)
    if found := claims_in(text):
        raise ValueError(f"the report of {stage} claims: {', '.join(found)}")
    return text
