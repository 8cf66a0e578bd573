"""Mining of meeting transcripts held as a table, many at a time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ACCENTED, PLAIN, fold_accents, safe_div
from ..functions.scale import hot_counted, landed, ordered_rank, running_sums

MERGE_BELOW = 700
SHORTEST_SENTENCE = 12
SHARED_WORDS = 2

# Caption and speaker forms, the trilingual phrases that mark a
# decision, a commitment, a risk or a date, the topics with their words, and
# the words too common to count.
CAPTION_TIME = r"(\d{2}):(\d{2}):(\d{2})[.,](\d{3})\s*-->\s*(\d{2}):(\d{2}):(\d{2})[.,](\d{3})"
SPEAKER_TAG = r"(?is)<v\s+([^>]+)>(.*?)(?:</v>)?\s*$"
SPEAKER_LINE = r"^\s*([A-ZÁÉÍÓÚÑ][\w .'À-ɏ-]{1,40}?)\s*:\s+"
DECISION = (
    r"decidimos|queda (?:definido|acordado|así)|acordamos|vamos a|se define|definimos|confirmamos|"
    r"arrancamos con|optamos por|we (?:agreed|decided|will)|let's go with|ficou (?:definido|acordado)|decidimos que"
)
COMMITMENT = (
    r"me encargo|yo lo hago|yo (?:te )?(?:paso|mando|env[íi]o)|te (?:paso|mando|env[íi]o)|queda pendiente|"
    r"nos queda|lo vemos|voy a (?:armar|mandar|pedir|revisar)|i'?ll (?:send|check|share|ask)|i will|"
    r"vou (?:mandar|passar|ver)"
)
RISK = (
    r"problema|riesgo|no tenemos|no existe|no hay|falta|complicado|bloquea|traba|risk|issue|blocker|"
    r"we don'?t have|missing|risco|n[ãa]o temos"
)
WHEN = (
    r"hoy|mañana|el lunes|el martes|el mi[ée]rcoles|el jueves|el viernes|la semana que viene|"
    r"pr[óo]xima semana|fin de mes|\d{1,2}/\d{1,2}(?:/\d{2,4})?|next week|tomorrow|semana que vem"
)
TOPICS = {
    "sources": ("sap", "erp", "crm", "origen", "source", "fonte", "base de datos", "database", "api", "planilla",
                "excel", "csv", "sftp", "archivo", "file", "extracción", "extraction"),
    "bronze": ("crudo", "raw", "histórico", "history", "retención", "retention", "backup", "respaldo", "reproceso",
               "reprocess"),
    "silver": ("limpieza", "cleansing", "transformación", "transform", "duplicado", "duplicate", "código", "codigo",
               "equivalencia", "mapeo", "mapping", "anulado", "filtro", "filter"),
    "quality": ("calidad", "quality", "error", "inconsistencia", "validación", "validation", "control", "cuadrar",
                "conciliar", "reconcile", "falta", "vacío", "nulo", "null"),
    "gold": ("dimensión", "dimension", "hecho", "fact", "granularidad", "grain", "jerarquía", "hierarchy", "modelo",
             "model", "estrella", "star", "calendario", "calendar", "histórico de cambios"),
    "warehouse": ("warehouse", "almacén", "servidor", "server", "base corporativa", "lago", "lake", "publicar",
                  "publish", "ventana", "window"),
    "governance": ("gobernanza", "governance", "dueño", "owner", "pii", "dato personal", "personal data", "permiso",
                   "acceso", "access", "auditoría", "audit", "normativa", "regulación", "confidencial", "sensible"),
    "ml": ("modelo", "predic", "machine learning", "score", "probabilidad", "probability", "algoritmo", "entrenar",
           "train", "target", "objetivo"),
    "report": ("reporte", "report", "kpi", "indicador", "métrica", "metric", "tablero", "dashboard", "fórmula",
               "formula", "informe"),
    "measures": ("dax", "medida", "measure", "cálculo", "calculo", "mes anterior", "año anterior", "acumulado",
                 "year to date", "ytd"),
    "bi_file": ("power bi", "powerbi", "tableau", "licencia", "license", "workspace", "espacio de trabajo",
                "publicación", "refresco", "refresh"),
    "delivery": ("automatizar", "automation", "frecuencia", "frequency", "horario", "schedule", "cron", "producción",
                 "production", "responsable", "soporte", "support", "entrega", "deploy"),
}
STOP_WORDS = ["que", "los", "las", "del", "una", "por", "con", "para", "como", "esta", "este", "hay", "the", "and",
              "for", "with", "that", "this", "from", "are", "was", "have", "uma", "com", "isso", "mas", "não", "sim"]


def phrase(words: str) -> str:
    """Case-insensitive whole-phrase pattern with Unicode word edges."""
    return rf"(?iU)\b(?:{words})\b"


def parse_transcripts(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """WebVTT / SRT captions or `Name: text` lines to one row per spoken piece.

    Each document is opened with array expressions inside its own row; lines
    without a speaker continue the one before.
    """
    clean = F.regexp_replace(F.regexp_replace(text, r"\r\n", "\n"), r"\r", "\n")
    base = docs.select(F.col(doc).alias("doc"), clean.alias("__t")).where(F.length(F.trim("__t")) > 0)
    timed = F.upper(F.ltrim("__t")).startswith("WEBVTT") | F.col("__t").rlike(CAPTION_TIME)
    return _captions(base.where(timed)).unionByName(_plain(base.where(~timed)))


def _captions(base: DataFrame) -> DataFrame:
    def clock(i):
        part = lambda k: F.regexp_extract("__b", CAPTION_TIME, i + k).try_cast("int")
        return part(0) * 3600 + part(1) * 60 + part(2) + part(3) / 1000.0

    blocks = base.select("doc", F.posexplode(F.split("__t", r"\n\s*\n")).alias("at", "__b")).where(F.col("__b").rlike(CAPTION_TIME))
    body = F.trim(F.regexp_replace("__b", r"(?s)^.*?" + CAPTION_TIME, ""))
    body = F.regexp_replace(body, r"(?m)^\s*\d+\s*$\n?", "")
    blocks = blocks.select("doc", "at", clock(1).alias("start_s"), clock(5).alias("end_s"), F.btrim(body, F.lit(" \n\t")).alias("__c"))
    tagged, lined = F.col("__c").rlike(SPEAKER_TAG), F.col("__c").rlike(SPEAKER_LINE)
    speaker = F.when(tagged, F.trim(F.regexp_extract("__c", SPEAKER_TAG, 1))).when(
        lined, F.trim(F.regexp_extract("__c", SPEAKER_LINE, 1))
    )
    said = F.when(tagged, F.regexp_extract("__c", SPEAKER_TAG, 2)).when(
        lined, F.regexp_replace("__c", SPEAKER_LINE, "")
    ).otherwise(F.col("__c"))
    said = F.btrim(F.regexp_replace(said, r"<[^>]+>", ""), F.lit(" \n\t"))
    return blocks.select("doc", F.col("at").cast("bigint").alias("turn"), speaker.alias("speaker"), "start_s", "end_s", said.alias("text")).where("text <> ''")


def _plain(base: DataFrame) -> DataFrame:
    pieces = F.split("__t", r"\n+(?=" + SPEAKER_LINE[1:] + ")")
    rows = base.select("doc", F.posexplode(pieces).alias("at", "__p")).where(F.length(F.trim("__p")) > 0)
    lined = F.col("__p").rlike(SPEAKER_LINE)
    said = F.when(lined, F.regexp_replace("__p", SPEAKER_LINE, "")).otherwise(F.col("__p"))
    joined = F.trim(F.regexp_replace(said, r"\s*\n\s*", " "))
    return rows.select(
        "doc", F.col("at").cast("bigint").alias("turn"),
        F.when(lined, F.trim(F.regexp_extract("__p", SPEAKER_LINE, 1))).alias("speaker"),
        F.lit(None).cast("double").alias("start_s"), F.lit(None).cast("double").alias("end_s"), joined.alias("text"),
    ).where("text <> ''")


def speaker_runs(turns: DataFrame) -> DataFrame:
    """Number the uninterrupted runs of one speaker inside each document.

    Neighbours meet by equi-join on dense positions and runs are opened from
    their bounds, so a very long document spreads over many tasks.
    """
    dense = ordered_rank(turns, "turn", "turn", ["doc"], out="position", total="doc_turns")
    before = dense.select("doc", (F.col("position") + 1).alias("position"), F.struct("speaker").alias("__prev"))
    first = F.col("__prev").isNull() | ~F.col("__prev.speaker").eqNullSafe(F.col("speaker"))
    starts = (
        dense.select("doc", "position", "speaker", "doc_turns").join(before, ["doc", "position"], "left")
        .where(first).select("doc", "position", "doc_turns")
    )
    numbered = ordered_rank(starts, "position", "position", ["doc"], out="run", total="runs")
    following = numbered.select("doc", (F.col("run") - 1).alias("run"), F.col("position").alias("__next"))
    opened = numbered.join(following, ["doc", "run"], "left").select(
        "doc", "run",
        F.explode(F.sequence("position", F.coalesce(F.col("__next") - 1, F.col("doc_turns")))).alias("position"),
    )
    return dense.drop("doc_turns").join(opened, ["doc", "position"])


def merge_turns(turns: DataFrame) -> DataFrame:
    """Join consecutive turns of one speaker while the text gathered so far is short.

    Captions cut a sentence every few seconds.  Where a gathered text ends depends
    on where it began, so every turn is asked where a text beginning there would end,
    and only the beginnings that follow from a run's first turn count:

    1. running lengths of the trimmed texts, over all tasks;
    2. a text that begins at a turn ends with the first turn at which the running length
       is `MERGE_BELOW` more; turns lie in buckets of so many characters, so this
       meets by equi-join inside a bucket;
    3. from the runs' first turns, jumps of 1, 2, 4, ... texts reach every beginning, in
       as many rounds as the logarithm of the texts in the longest run.

    Turns of runs that stay short skip 2 and 3.  Blank turns join whatever is open.
    """
    edges = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
    said = F.regexp_replace("text", edges, "")
    runs = speaker_runs(turns).select("doc", "run", "position", "turn", "speaker", "start_s", "end_s", "text")
    sized = runs.withColumns({
        "__said": said, "__raw": F.length("text"), "__w": F.when(said != "", F.length(said) + 1).otherwise(0),
    })
    placed = landed(running_sums(sized, {"__upto": "__w"}, [F.col("position")], ["doc"]))
    bounds = landed(placed.groupBy("doc", "run").agg(
        F.min("position").alias("first"), F.max("position").alias("last"), F.sum("__w").alias("__size"), F.max("__raw").alias("__longest"),
    ))
    cut = (F.col("last") > F.col("first")) & ((F.col("__size") > MERGE_BELOW) | (F.col("__longest") >= MERGE_BELOW))
    long_ = placed.join(bounds.where(cut).select("doc", "run", "last"), ["doc", "run"]).select(
        "doc", "run", "position", "last", "__raw", (F.col("__upto") - F.col("__w")).alias("__low"), F.col("__upto").alias("__high")
    )
    width = MERGE_BELOW + 1
    ends = long_.where("__high > __low").select(
        "doc", "run", F.col("position").alias("__end"), F.col("__low").alias("__after"), F.col("__high").alias("__by"),
        F.explode(F.sequence(F.floor((F.col("__low") + 1) / width), F.floor(F.col("__high") / width))).alias("__bucket"),
    )
    asked = long_.where(F.col("__raw") < MERGE_BELOW).select(
        "doc", "run", "position", "last", (F.col("__low") + width).alias("__until"), F.floor((F.col("__low") + width) / width).alias("__bucket")
    )
    met = asked.join(ends, ["doc", "run", "__bucket"]).where("__after < __until AND __until <= __by")
    alone = long_.where(F.col("__raw") >= MERGE_BELOW).withColumn("__end", F.col("position"))
    jumps = [x.where("__end < last").select("doc", "position", (F.col("__end") + 1).alias("next")) for x in (met, alone)]
    one = landed(jumps[0].unionByName(jumps[1]))
    begins, reached, jump = [bounds.where(cut).select("doc", F.col("first").alias("position"))], None, one
    while True:
        reached = reduce(DataFrame.unionByName, begins)
        more = landed(reached.join(jump, ["doc", "position"]).select("doc", F.col("next").alias("position")))
        if more.isEmpty():
            break
        begins.append(more)
        further = jump.select("doc", F.col("position").alias("next"), F.col("next").alias("__next"))
        jump = landed(jump.join(further, ["doc", "next"]).select("doc", "position", F.col("__next").alias("next")))
    starts = reached.join(one, ["doc", "position"], "left").select("doc", F.col("position").alias("begin"), "next")
    whole = bounds.where(~cut).select("doc", F.col("first").alias("begin"), (F.col("last") + 1).alias("next"))
    opened = _run_ends(starts, placed, bounds).unionByName(whole).select("doc", "begin", F.explode(F.sequence("begin", F.col("next") - 1)).alias("position"))
    gathered = placed.join(opened, ["doc", "position"]).groupBy("doc", "begin").agg(
        F.min_by(F.struct("turn", "speaker", "start_s", "text"), "position").alias("__a"),
        F.max_by("end_s", "position").alias("end_s"), F.count(F.lit(1)).alias("__n"),
        F.array_sort(F.collect_list(F.when(F.col("__w") > 0, F.struct("position", "__said")))).alias("__parts"),
    )
    joined = F.array_join(F.col("__parts.__said"), " ")
    return gathered.select(
        "doc", "__a.turn", "__a.speaker", "__a.start_s", "end_s", F.when(F.col("__n") == 1, F.col("__a.text")).otherwise(joined).alias("text")
    )


def _run_ends(starts: DataFrame, placed: DataFrame, bounds: DataFrame) -> DataFrame:
    """`next` of the last text of a run: the turn after the run."""
    run = placed.select("doc", F.col("position").alias("begin"), "run").join(bounds.select("doc", "run", "last"), ["doc", "run"])
    return starts.join(run, ["doc", "begin"]).select("doc", "begin", F.coalesce("next", F.col("last") + 1).alias("next"))


def words(c: str | Column) -> Column:
    text = F.trim(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"\s+", " "))
    return F.when(F.length(text) > 0, F.size(F.split(text, " "))).otherwise(0)


def participants(turns: DataFrame) -> DataFrame:
    """Who spoke and how much, per document; unnamed speakers are `?`."""
    grouped = turns.groupBy("doc", F.coalesce("speaker", F.lit("?")).alias("speaker")).agg(
        F.count(F.lit(1)).alias("turns"),
        F.sum(words("text")).cast("bigint").alias("words"),
        F.coalesce(F.sum(F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s"))), F.lit(0.0)).alias("seconds"),
    )
    whole = grouped.groupBy("doc").agg(F.sum("words").alias("__all"))
    return grouped.join(whole, "doc").withColumn(
        "words_pct", F.coalesce(safe_div("words", "__all") * 100, F.lit(0.0))
    ).drop("__all")


def sentences(turns: DataFrame) -> DataFrame:
    """Sentences longer than a dozen characters, numbered inside their turn."""
    cut = F.split("text", r"(?<=[.!?])\s+|\n+")
    rows = turns.select("doc", "turn", "speaker", "start_s", F.posexplode(cut).alias("at", "__s"))
    said = F.btrim("__s", F.lit(" \n\t\r"))
    return rows.select("doc", "turn", F.col("at").cast("bigint").alias("sentence"), "speaker", "start_s", said.alias("text")).where(
        F.length("text") > SHORTEST_SENTENCE
    )


def minutes(lines: DataFrame) -> DataFrame:
    """Sentences that decide, commit, warn or ask, one flag each."""
    t = F.col("text")
    when = F.regexp_extract(t, rf"(?iU)\b({WHEN})\b", 1)
    out = lines.withColumns(
        {
            "decision": t.rlike(phrase(DECISION)),
            "commitment": t.rlike(phrase(COMMITMENT)),
            "risk": t.rlike(phrase(RISK)),
            "question": F.rtrim(t).endswith("?"),
        }
    ).where("decision or commitment or risk or question")
    return out.withColumn("due", F.when(F.col("commitment") & (when != ""), when))


def _fold(text: str) -> str:
    return text.lower().translate(str.maketrans(ACCENTED, PLAIN))


def topic_mentions(lines: DataFrame) -> DataFrame:
    """Each sentence once per topic any of whose words it contains."""
    def mentions(keys):
        found = [F.col("__folded").contains(w) for w in sorted({_fold(w) for w in keys})]
        return reduce(lambda a, b: a | b, found)

    hits = F.array_compact(
        F.array(*[F.when(mentions(keys), F.lit(topic)) for topic, keys in TOPICS.items()])
    )
    return lines.withColumn("__folded", fold_accents("text")).select(*lines.columns, F.explode(hits).alias("topic"))


def _tokens(c: Column) -> Column:
    found = F.regexp_extract_all(fold_accents(c), F.lit(r"(?U)\w{4,}"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOP_WORDS)))


def best_passage(questions: DataFrame, lines: DataFrame, splits: int = 64) -> DataFrame:
    """Per question the sentence sharing most words, two at least, first wins.

    Sentences are numbered by (doc, turn, sentence).  Two shared words mean that one of
    them is not the question's most frequent word.  So only the other words seek
    sentences, and the most frequent one is looked up in the sentences found, by word
    and sentence together.  A seeking word that many sentences hold is split over
    `splits` keys by sentence; the best of each question is a minimum per key.
    """
    key = ["doc", "turn", "sentence"]
    asked = questions.select("question_id", F.explode(_tokens(F.col("question"))).alias("w"))
    said = lines.select(*key, F.explode(_tokens(F.col("text"))).alias("w"))
    counts = landed(said.groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    weighed = asked.join(counts, "w")  # a word that no sentence holds shares nothing
    common = weighed.groupBy("question_id").agg(F.max(F.struct("n", "w")).alias("m"), F.count(F.lit(1)).alias("words"))
    common = common.where(F.col("words") >= SHARED_WORDS).select("question_id", F.col("m.w").alias("common"))
    seeking = weighed.join(common, "question_id").where("w <> common").select("question_id", "w")
    hot = F.broadcast(hot_counted(counts, "w", "n").withColumn("__hot", F.lit(True)))
    part = F.pmod(F.xxhash64(*key), F.lit(splits)).cast("int")
    every = F.sequence(F.lit(0), F.lit(splits - 1))
    parted = said.join(hot, "w", "left").withColumn("__part", F.when(F.col("__hot"), part).otherwise(0)).drop("__hot")
    seekers = seeking.join(hot, "w", "left").select(
        "question_id", "w", F.explode(F.when(F.col("__hot"), every).otherwise(F.array(F.lit(0)))).alias("__part")
    )
    found = parted.join(seekers, ["w", "__part"]).groupBy("question_id", *key).agg(F.count(F.lit(1)).alias("shared"))
    asks = found.join(common, "question_id")
    held = said.join(common.select(F.col("common").alias("w")).distinct(), "w", "left_semi").withColumnRenamed("w", "common")
    shared = asks.join(held.withColumn("__there", F.lit(1)), [*key, "common"], "left").withColumn(
        "shared", F.col("shared") + F.coalesce("__there", F.lit(0))
    )
    best = (
        shared.where(F.col("shared") >= SHARED_WORDS)
        .groupBy("question_id")
        .agg(F.min_by(F.struct(*key, "shared"), F.struct(-F.col("shared"), *key)).alias("b"))
        .select("question_id", "b.*")
    )
    return best.join(lines.select(*key, "speaker", "text"), key)
