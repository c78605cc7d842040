"""Contract and review of generated captions: seven labelled lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docgrid.functions import text as T

#: Labels in order, technical types, prompts, length, and the reasons of a review.
LABELS = ("Tipo tecnico", "Oggetto", "Elementi visibili", "Relazioni/funzione", "Valori/avvertenze", "Rilevanza RAG", "Incertezze")
TYPES = ("schema elettrico", "schema/diagramma", "componente/assemblaggio", "UI/HMI", "tabella tecnica", "sicurezza", "altro tecnico")
PROMPTS, CURRENT, MOST = ("technical-caption-v2", "technical-caption-v3", "technical-caption-v4"), "technical-caption-v4", 1200
ELECTRICAL = "generated caption for an electrical schematic requires manual visual review"
UNCERTAIN = "generated caption declares no uncertainty but contains an uncertain reading"
WIRING = {
    "technical-caption-v3": r"(?U)\b(?:elettric\w*|cablaggio|wiring|interruttore|messa a terra)\b",
    "technical-caption-v4": r"(?U)\b(?:circuito elettrico|schema elettrico|cablaggio|wiring|messa a terra)\b",
}
NONE, UNREADABLE = r"(?U)^nessun[aoe]?\b", r"(?U)\b(?:non\s+(?:leggibil[ei]|determinabil[ei]|chiar[oaie])|illeggibil[ei])\b"


def fields(caption: Column) -> Column:
    """(label, value) of each line that is not empty; value is null without a colon."""
    lines = F.filter(F.transform(F.split(caption, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85]"), _strip), lambda t: t != "")
    at = lambda t: F.instr(t, ":")
    return F.transform(lines, lambda t: F.struct(F.when(at(t) > 0, _strip(F.substring_index(t, ":", 1))).alias("label"), F.when(at(t) > 0, _strip(F.substr(t, at(t) + 1))).alias("value")))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{T.SPACE}+|{T.SPACE}+$", "")


def technical_type(value: Column) -> Column:
    """The canonical technical type, null if it is none."""

    def known(folded: Column) -> Column:
        out = F.when(folded.contains("elettric") | folded.contains("wiring"), TYPES[0])
        for name in TYPES:
            out = out.when(folded == name.lower(), name)
        return out

    return T.let(T.fold(T.squeeze(value)), known)


def canonical_caption(caption: Column, prompt: Column | None = None) -> Column:
    """The caption with its type and spacing made canonical; null where it breaks the contract."""
    prompt = F.lit(CURRENT) if prompt is None else prompt
    short = (prompt == CURRENT) | (F.char_length(_strip(caption)) <= MOST)

    def of_fields(f: Column) -> Column:
        labels = F.transform(f, lambda x: F.coalesce(x["label"], F.lit("")))
        good = (labels == F.array(*map(F.lit, LABELS))) & ~F.exists(f, lambda x: x["value"] == "")
        return F.when(good, T.let(technical_type(F.get(f, F.lit(0))["value"]), lambda kind: of_kind(f, kind)))

    def of_kind(f: Column, kind: Column) -> Column:
        lines = F.transform(f, lambda x, i: F.concat(x["label"], F.lit(": "), F.when(i == 0, kind).otherwise(x["value"])))
        return F.when(kind.isNotNull(), F.array_join(lines, "\n"))

    return F.when(caption.isNotNull() & prompt.isin(*PROMPTS) & short, T.let(fields(caption), of_fields))


def review_reason(caption: Column, prompt: Column | None = None) -> Column:
    """Why a canonical caption needs a review, or null."""
    prompt = F.lit(CURRENT) if prompt is None else prompt

    def of_fields(f: Column) -> Column:
        said = lambda keep: T.fold(F.array_join(F.transform(F.filter(f, keep), lambda x: x["value"]), " "))

        def wired(seen: Column) -> Column:
            out = F.lit(False)
            for name, pattern in WIRING.items():
                out = out | ((prompt == name) & seen.rlike(pattern))
            return out

        seen = said(lambda x: x["label"].isin(LABELS[1], LABELS[2], LABELS[3]))
        sure = said(lambda x: x["label"] == LABELS[6]).rlike(NONE) & said(lambda x: x["label"] != LABELS[6]).rlike(UNREADABLE)
        electrical = lambda kind: (kind == TYPES[0]) | ((kind == TYPES[1]) & T.let(seen, wired))
        kind = technical_type(F.get(f, F.lit(0))["value"])
        return F.when(T.let(kind, electrical), ELECTRICAL).when((prompt != PROMPTS[0]) & sure, UNCERTAIN)

    return F.when(caption.isNotNull(), T.let(fields(caption), of_fields))
