"""The text that a caption is asked with, and the digest by which it can be asked again.

``rows`` are a document's elements in reading order: (doc_id, idx, element_id, type, page, path array,
text, caption_original).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgrid.functions import text as T
from docgrid.operators import captions

#: Rows of context, characters of one, of all and of a table.
ITEMS, ITEM, CONTEXT, TABLE = 6, 600, 2400, 2200
#: The prompt, word by word, with names for what is filled in.
PROMPT = """Ruolo: technical writer e ingegnere di sistema per manuali industriali.
Task: genera caption_generated per una pipeline RAG unimodale. La caption deve trasformare contenuto visuale o tabellare in testo tecnico ricercabile, non in descrizione narrativa.

Fonte primaria: {visual}
Descrivi SOLO cio che e effettivamente visibile. NON nominare dispositivi, impianti o componenti non raffigurati: se non li vedi, non vanno nella caption. Usa il testo vicino SOLO per nomi o sigle di cio che vedi, non per aggiungere elementi nuovi. Puoi includere una sola avvertenza direttamente collegata, compressa in poche parole. Non inventare dettagli non visibili. Se testo, valori o componenti non sono leggibili, scrivi "non leggibile" o "non determinabile". Non correggere table_markdown e non inventare righe o colonne. Non ripetere lo stesso elemento piu di una volta.

Manuale: {title}
Tipo: {type}
Pagina: {page}
Capitolo: {chapter}
Caption originale: {original}
Contesto locale della pagina (fonti immutabili): {context}{table}

{format}
Tipo tecnico: scegli una sola categoria tra schema elettrico, schema/diagramma, componente/assemblaggio, UI/HMI, tabella tecnica, sicurezza, altro tecnico
Oggetto: oggetto o procedura rappresentata
Elementi visibili: massimo 8 elementi unici realmente visibili
Relazioni/funzione: collegamenti, disposizione spaziale visibile, sequenza o significato operativo; indica la posizione solo se chiaramente visibile, mai dedotta
Valori/avvertenze: codici, unita, parametri o avvisi visibili; altrimenti non applicabile
Rilevanza RAG: una domanda operativa breve
Incertezze: nessuna evidente oppure dettagli non leggibili

Rispondi solo con i sette campi, nello stesso ordine."""
#: The lines that depend on an image, on a table, and on the prompt's version.
WITH_IMAGE, WITHOUT_IMAGE = "Analizza anche l'immagine allegata.", "Non hai un'immagine allegata: usa solo il testo strutturato disponibile."
ABSENT, TABLE_HEAD = ("Non disponibile", "Non disponibile"), "\nMarkdown tabella originale:\n"
STRICT, ADVISED = "Formato obbligatorio, massimo {} caratteri:", "Formato obbligatorio; lunghezza consigliata entro {} caratteri:"


def page_context(rows: DataFrame, targets: DataFrame, most: int = ITEMS) -> DataFrame:
    """(doc_id, idx, context) for each of ``targets`` (doc_id, idx): the ``most`` nearest texts of its page and chapter.

    Texts are ranked by their distance in the document, and given in its order. A target is joined by
    the running number of texts with ``most`` of them on either side, not with all of its page.
    """
    said = F.coalesce(F.nullif("text", F.lit("")), F.nullif("caption_original", F.lit("")))
    told = F.struct("idx", F.concat(F.lit("["), F.col("element_id").cast("string"), F.lit("] "), T.truncate(said, ITEM)).alias("line"))
    place = W.partitionBy("doc_id", "page", "path").orderBy("idx")
    texts = rows.withColumn("_said", said)
    # the rows with text next to a target on either side are those by its running number of texts
    n = F.count(F.when(F.col("_said").isNotNull(), 1)).over(place.rowsBetween(W.unboundedPreceding, -1))
    texts = texts.withColumn("_n", n)
    wanted = texts.join(targets.select("doc_id", "idx").distinct(), ["doc_id", "idx"], "left_semi").select("doc_id", "page", "path", F.col("idx").alias("_at"), F.explode(F.sequence(F.col("_n") - most, F.col("_n") + most)).alias("_n"))
    found = wanted.join(texts.filter("_said is not null").select("doc_id", "page", "path", "_n", told.alias("_told")), ["doc_id", "page", "path", "_n"]).filter("_told.idx <> _at")
    rank = F.row_number().over(W.partitionBy("doc_id", "_at").orderBy(F.abs(F.col("_told.idx") - F.col("_at")), "_told.idx"))
    found = found.withColumn("_r", rank).filter(F.col("_r") <= most)
    context = found.groupBy("doc_id", F.col("_at").alias("idx")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_told")), lambda t: t["line"]), "\n").alias("context"))
    return targets.select("doc_id", "idx").distinct().join(context, ["doc_id", "idx"], "left").select("doc_id", "idx", F.coalesce("context", F.lit("")).alias("context"))


def sections(rows: DataFrame) -> DataFrame:
    """``rows`` with the section of their page they belong to: a title and the texts up to the next title, image or table.

    Null before the first title of a page and after an image or table.
    """
    page = W.partitionBy("doc_id", "page").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    breaks = F.col("type").isin("title", "image", "table")
    rows = rows.withColumn("_b", F.count(F.when(breaks, 1)).over(page)).withColumn("_title", F.max(F.when(F.col("type") == "title", F.col("_b"))).over(page))
    inside = (F.col("_b") == F.col("_title")) & F.col("type").isin("title", "text")
    return rows.withColumn("section", F.when(inside, F.col("_b"))).drop("_b", "_title")


def figure_context(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, idx, titles, context) of ``targets`` (doc_id, idx, page, figure): the sections of the page that name the figure.

    Targets that no section names are left out; a null figure names none.
    """
    s = sections(rows).filter("section is not null")
    said = s.groupBy("doc_id", "page", "section").agg(F.array_sort(F.collect_list(F.struct("idx", "element_id", "type", "text"))).alias("_rows"))
    t = targets.filter("figure is not null").select("doc_id", "page", F.col("idx").alias("_at"), "figure")
    named = F.exists("_rows", lambda r: F.coalesce(F.regexp_like(r["text"], F.concat(F.lit(rf"(?i)(?<![{T.WORD}])Fig\.?\s*"), F.col("figure"), F.lit(rf"(?![{T.WORD}])"))), F.lit(False)))
    hits = said.join(t, ["doc_id", "page"]).filter(named)
    hits = hits.groupBy("doc_id", F.col("_at").alias("idx"), "figure").agg(F.array_sort(F.flatten(F.collect_list("_rows"))).alias("_rows"))
    titles = F.transform(F.filter("_rows", lambda r: (r["type"] == "title") & (r["text"] != "")), lambda r: T.squeeze_ends(r["text"]))
    lines = F.transform(F.filter(F.slice("_rows", 1, ITEMS), lambda r: r["text"] != ""), lambda r: F.concat(F.lit("["), r["element_id"].cast("string"), F.lit("] "), T.truncate(r["text"], ITEM)))
    return hits.select("doc_id", "idx", F.when(F.size(titles) > 0, titles).otherwise(F.array(F.concat(F.lit("Fig. "), "figure"))).alias("titles"), F.array_join(lines, "\n").alias("context"))


def prompt(title: Column, kind: Column, page: Column, path: Column, original: Column, context: Column, table: Column, has_image: Column, version: Column, most: int = captions.MOST) -> Column:
    """The prompt of a version, null for one that is unknown."""
    or_absent = lambda c, absent: F.when(F.coalesce(c, F.lit("")) == "", absent).otherwise(c)
    fill = {
        "visual": F.when(has_image, WITH_IMAGE).otherwise(WITHOUT_IMAGE), "title": title, "type": kind, "page": page.cast("string"), "chapter": or_absent(F.array_join(path, " > "), ABSENT[0]), "original": or_absent(original, ABSENT[0]),
        "context": or_absent(T.truncate(context, CONTEXT), ABSENT[1]), "table": F.when(F.coalesce(table, F.lit("")) == "", "").otherwise(F.concat(F.lit(TABLE_HEAD), T.truncate(table, TABLE))),
        "format": F.when(version == captions.CURRENT, ADVISED.format(most)).otherwise(STRICT.format(most)),
    }
    parts, rest = [], PROMPT
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), fill[name]]
    return F.when(version.isin(*captions.PROMPTS), F.concat(*parts, F.lit(rest)))


def request_digest(element_id: Column, kind: Column, prompt: Column, asset: Column) -> Column:
    """The digest of a request: id, type, prompt and the bytes of the asset, if there is one."""
    return F.sha2(F.concat(*(F.encode(c, "UTF-8") for c in (element_id, kind, prompt)), F.coalesce(asset, F.lit(b""))), 256)


def input_errors(captioned: DataFrame) -> DataFrame:
    """(doc_id, element_id) of captions whose input_sha256 is not that of (element_id, type, prompt, asset)."""
    digest = request_digest(F.col("element_id").cast("string"), F.col("type"), F.col("prompt"), F.col("asset"))
    return captioned.filter(~F.col("input_sha256").eqNullSafe(digest)).select("doc_id", "element_id")


def clean_caption(text: Column) -> Column:
    """A provider's answer: each line squeezed, empty ones left out."""
    return T.squeeze_lines(text)
