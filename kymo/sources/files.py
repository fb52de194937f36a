"""Readers and writers of the files that recordings leave behind: JSON, JSON lines, tables of words, captions, ledgers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from .shared import shared_dir

# File suffixes of media.
VIDEO = ("mp4", "mkv", "avi", "mov", "webm", "wmv", "flv", "ts", "m4v", "mpg", "mpeg", "3gp")
AUDIO = ("mp3", "m4a", "wav", "aac", "flac", "ogg", "opus", "wma", "aiff", "aif", "amr", "mka", "oga", "3ga", "caf", "ac3", "m4b", "mp2", "au")
#: Version of a source's fingerprint, its length, and the bytes read at each end of a file.
FINGERPRINT_VERSION, FINGERPRINT_LENGTH, FINGERPRINT_BYTES = 3, 20, 1 << 20
STATE = "status string, stage string, progress double, video_path string, updated_at string, last_error string, artifacts map<string, string>"
LEDGER = "seq long, key string, at string, status string, duration double, elapsed double, quality double, outputs array<string>"
AUDIT = "source string, bytes long, outputs array<string>, text_left_device boolean, status string, cloud_providers array<string>"


def read_jobs(spark: SparkSession, glob: str, schema: str = STATE) -> DataFrame:
    """One JSON file a job; a file that can't be read is a failed job, never an error."""
    rows = spark.read.schema(f"{schema}, _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(glob)
    status = F.when(F.col("_bad").isNotNull(), F.lit("failed")).otherwise(F.col("status"))
    return rows.withColumn("job_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)).withColumn("status", status).drop("_bad")


def read_ledger(spark: SparkSession, path: str, schema: str = LEDGER) -> DataFrame:
    """JSON lines in order of ``seq``: fields that aren't known are left out, cut lines too."""
    parsed = spark.read.text(path).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"))
    return parsed.filter(F.col("r.seq").isNotNull()).select("r.*")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Flat audit rows."""
    return spark.read.schema(AUDIT).json(path)


def recordings_summary(spark: SparkSession, path: str) -> DataFrame:
    """Number of side-car files and their seconds; one that can't be read counts with none."""
    rows = spark.read.schema("duration_seconds string, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.agg(F.count(F.lit(1)).alias("recordings"), F.sum(F.coalesce(F.expr("try_cast(duration_seconds AS DOUBLE)"), F.lit(0.0))).alias("seconds"))


def read_ocr_tsv(spark: SparkSession, path: str, scale: float = 1.0) -> DataFrame:
    """Words with a text, a confidence of 0 or more and a box that can be read; coordinates over the scale."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    box = {c: F.expr(f"try_cast({c} AS DOUBLE)") / scale for c in ("left", "top", "width", "height")}
    rows = rows.withColumns({**box, "conf": F.expr("try_cast(conf AS DOUBLE)")})
    return rows.filter((F.trim("text") != "") & (F.col("conf") >= 0) & F.col("left").isNotNull() & F.col("top").isNotNull() & F.col("width").isNotNull() & F.col("height").isNotNull())


PROBE = "format struct<duration: string>, streams array<struct<codec_type: string, codec_name: string, width: int, height: int, avg_frame_rate: string, r_frame_rate: string, sample_rate: string, tags: map<string, string>, side_data_list: array<struct<rotation: int>>>>"


def probe_facts(probes: DataFrame, column: str = "json") -> DataFrame:
    """Media facts from a probe's JSON: frame rate as a fraction, rotation, swapped sides when it lies on its side."""
    p = F.from_json(column, PROBE)
    video = F.get(F.filter(p["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    audio = F.get(F.filter(p["streams"], lambda s: s["codec_type"] == "audio"), F.lit(0))
    rate = lambda c: F.try_divide(F.split(c, "/")[0].cast("double"), F.split(c, "/")[1].cast("double"))
    rows = probes.withColumns({"v": video, "a": audio, "duration_seconds": p["format"]["duration"].cast("double")})
    turn = F.coalesce(F.get(F.col("v.side_data_list"), F.lit(0))["rotation"], F.col("v.tags")["rotate"].cast("int"), F.lit(0))
    side = F.abs(turn) % 180 == 90
    fps = F.coalesce(F.nullif(rate(F.coalesce(F.col("v.avg_frame_rate"), F.lit("0/0"))), F.lit(0.0)), rate(F.coalesce(F.col("v.r_frame_rate"), F.lit("0/0"))), F.lit(0.0))
    return rows.withColumns({"rotation": turn, "width": F.when(side, F.col("v.height")).otherwise(F.col("v.width")), "height": F.when(side, F.col("v.width")).otherwise(F.col("v.height")), "fps": fps, "codec": F.col("v.codec_name"), "has_video": F.col("v").isNotNull(), "has_audio": F.col("a").isNotNull()}).drop("v", "a")


def media_inventory(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Name, size and time of the media files of a folder; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder).select("path", "length", "modificationTime")
    suffix = F.lower(F.element_at(F.split("path", "[.]"), -1))
    return files.withColumn("suffix", suffix).filter(suffix.isin(*VIDEO, *AUDIO)).withColumn("is_video", suffix.isin(*VIDEO))


def source_fingerprints(files: DataFrame) -> DataFrame:
    """Path, name, size and ``fingerprint`` of binary files (path, length, content): name, size, first and last megabyte.

    A moved or touched file keeps its fingerprint. Spark's reader of binary files gives whole
    contents, at most 2 GB each, and leaves empty files out.
    """
    name = F.element_at(F.split("path", "/"), -1)
    sample = F.least(F.lit(FINGERPRINT_BYTES), F.col("length")).cast("int")
    head = F.substring("content", F.lit(1), sample)
    tail = F.when(F.col("length") > FINGERPRINT_BYTES, F.substring("content", (F.col("length") - FINGERPRINT_BYTES + 1).cast("int"), F.lit(FINGERPRINT_BYTES))).otherwise(F.lit(b""))
    label = F.concat(F.lit(f"v{FINGERPRINT_VERSION}|"), name, F.lit("|"), F.col("length").cast("string")).cast("binary")
    return files.select("path", name.alias("name"), F.col("length").alias("size"), F.left(F.sha2(F.concat(label, head, tail), 256), F.lit(FINGERPRINT_LENGTH)).alias("fingerprint"))


def pending_files(inventory: DataFrame, done: DataFrame) -> DataFrame:
    """Files of an inventory (path, length, modificationTime) that no row of the ledger ``done`` has with that name, size and time."""
    name = F.element_at(F.split("path", "/"), -1)
    return inventory.withColumn("name", name).join(done.select("name", "length", "modificationTime").distinct(), ["name", "length", "modificationTime"], "left_anti")


def parse_replies(replies: DataFrame, schema: str, column: str = "reply") -> DataFrame:
    """A model's reply as a struct: the whole text, a fenced block, or from the first brace on."""
    text = F.col(column)
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    first = F.when(F.locate("{", text) > 0, F.regexp_extract(text, r"(?s)(\{.*\})", 1))
    read = lambda t: F.when(F.try_parse_json(t).isNotNull(), F.from_json(t, schema))
    return replies.withColumn("parsed", F.coalesce(read(text), read(fenced), read(first)))


def explode_study_replies(replies: DataFrame, parsed: str = "parsed") -> DataFrame:
    """Questions of parsed replies: unknown kinds are mcq, unknown levels medium, ids only as numbers."""
    q = replies.select(*[c for c in replies.columns if c != parsed], F.posexplode(F.col(f"{parsed}.questions")).alias("item_idx", "q"))
    kind = F.when(F.col("q.kind").isin("mcq", "true_false", "short"), F.col("q.kind")).otherwise("mcq")
    level = F.when(F.col("q.difficulty").isin("easy", "medium", "hard"), F.col("q.difficulty")).otherwise("medium")
    ids = F.filter(F.transform("q.s", lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    return q.withColumns({"kind": kind, "difficulty": level, "segment_ids": ids, "question": F.col("q.question")}).drop("q")


#: Parts of a study reply: its list, the entry's front, its back, and other names of either.
STUDY_PARTS = {"objective": ("objectives", ["text"], []), "glossary": ("glossary", ["term"], ["definition"]), "question": ("questions", ["q", "question"], ["answer"]), "flashcard": ("flashcards", ["front"], ["back"])}


def study_items(replies: DataFrame, column: str = "reply") -> DataFrame:
    """All items of study replies (S10): ``item_type``, ``item_idx`` in its list, ``front``, ``back``, and of questions ``kind``, ``difficulty``, ``options``, ``explanation``; cited ``segment_ids``.

    A reply is read as a value of any shape, so one entry of a wrong type spoils no other: what isn't an object, or has no front, is left out; numbers
    and truths become text; unknown kinds are mcq, unknown levels medium; of cited ids those count that are whole numbers. Replies that hold no JSON have no items.
    """
    text = F.col(column)
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    first = F.when(F.locate("{", text) > 0, F.regexp_extract(text, r"(?s)(\{.*\})", 1))
    value = F.coalesce(F.try_parse_json(text), F.try_parse_json(fenced), F.try_parse_json(first))
    got = lambda v, path, kind="string": F.try_variant_get(v, path, kind)
    said = lambda v, names: F.coalesce(*[F.nullif(got(v, f"$.{n}"), F.lit("")) for n in names], F.lit(None).cast("string"))

    def entries(item_type: str) -> Column:
        found = F.coalesce(got(F.col("_value"), f"$.{STUDY_PARTS[item_type][0]}", "array<variant>"), F.array().cast("array<variant>"))
        return F.transform(found, lambda e, k: F.struct(F.lit(item_type).alias("item_type"), k.alias("item_idx"), e.alias("e")))

    lists = [entries(t) for t in STUDY_PARTS]
    each = replies.withColumn("_value", value).withColumn("_i", F.explode(F.concat(*lists))).drop("_value")
    e, kind = F.col("_i.e"), F.col("_i.item_type")
    pick = lambda which: F.coalesce(*[F.when(kind == t, said(e, parts[which])) for t, parts in STUDY_PARTS.items() if parts[which]])
    question = kind == "question"
    asked = lambda name: F.lower(F.trim(F.coalesce(said(e, [name]), F.lit(""))))
    of = lambda name, kinds, other: F.when(question, F.when(asked(name).isin(kinds), asked(name)).otherwise(other))
    ids = F.transform(F.coalesce(got(e, "$.s", "array<variant>"), F.array().cast("array<variant>")), lambda x: got(x, "$").try_cast("int"))
    options = F.transform(F.coalesce(got(e, "$.options", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.coalesce(got(x, "$"), F.lit("")))
    out = each.select(
        *[c for c in replies.columns if c != column], kind.alias("item_type"), F.col("_i.item_idx").alias("item_idx"), pick(1).alias("front"), F.coalesce(pick(2), F.lit("")).alias("back"),
        of("kind", ["mcq", "true_false", "short"], "mcq").alias("kind"), of("level", ["easy", "medium", "hard"], "medium").alias("difficulty"), F.when(question, options).alias("options"),
        F.when(question, F.coalesce(said(e, ["why", "explanation"]), F.lit(""))).alias("explanation"), F.filter(ids, lambda x: x.isNotNull()).alias("segment_ids"),
    )
    return out.filter("front IS NOT NULL")


def _study_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of replies about the benchmark's texts: every list, entries of wrong types among them."""
    q = lambda text: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(text, r"[\\\\\"]", " "), r"\s", " "), F.lit('"'))
    text = F.col("text")
    reply = F.concat(
        F.lit('Here it is: {"objectives": [{"text": '), q(F.substring(text, 1, 30)), F.lit(', "s": [1, "2", "x", null]}, "junk", {"text": ""}], "glossary": [{"term": '), q(F.substring(text, 5, 12)), F.lit(', "definition": null}], "questions": [{"question": '), q(F.substring(text, 2, 40)),
        F.lit(', "kind": " SHORT ", "level": "hardest", "options": [1, "b", null], "answer": true, "why": "", "explanation": "since"}, 7], "flashcards": [{"front": '), q(F.substring(text, 9, 20)), F.lit(', "back": 12}, {"back": "no front"}]} and that is all'),
    )
    replies = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("text IS NOT NULL").select("item_id", reply.alias("reply"))
    return study_items(replies).select("item_id", "item_type", "item_idx", "front", "back", "kind", "difficulty", F.array_join("options", "|").alias("options"), "explanation", F.array_join("segment_ids", ",").alias("segment_ids"))


def write_subtitles(cues: DataFrame, path: str, kind: str = "srt") -> None:
    """Captions as text, one folder a recording: number, stamps, at most two lines of 42 characters."""
    sep = "," if kind == "srt" else "."
    ms = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("long")
    stamp = lambda t: F.format_string("%02d:%02d:%02d" + sep + "%03d", F.floor(t / 3600000), F.floor(t % 3600000 / 60000), F.floor(t % 60000 / 1000), t % 1000)
    line = F.regexp_replace("text", r"^(.{1,42})\s+(.+)$", "$1\n$2")
    body = F.concat_ws("\n", F.col("cue").cast("string"), F.concat(stamp(ms("start_s")), F.lit(" --> "), stamp(ms("end_s"))), line, F.lit(""))
    head = F.lit("WEBVTT\n\n" if kind == "vtt" else "")
    joined = cues.withColumn("b", body).groupBy("recording_id").agg(F.concat(head, F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue", "b"))), lambda x: x["b"]), "\n")).alias("value"))
    joined.write.partitionBy("recording_id").mode("overwrite").text(path)


def write_transcripts(paragraphs: DataFrame, path: str, timecodes: bool = False) -> None:
    """Transcripts as text, one folder a recording."""
    t = F.floor("start_s").cast("long")
    stamp = F.format_string("[%02d:%02d:%02d] ", F.floor(t / 3600), F.floor(t % 3600 / 60), t % 60)
    text = F.concat(stamp, "text") if timecodes else F.col("text")
    joined = paragraphs.withColumn("p", text).groupBy("recording_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_s", "p"))), lambda x: x["p"]), "\n\n").alias("value"))
    joined.write.partitionBy("recording_id").mode("overwrite").text(path)


def write_flashcards(cards: DataFrame, path: str) -> None:
    """Front, back and clock time as CSV."""
    t = F.floor("start_s").cast("long")
    cards.select("front", "back", F.format_string("%02d:%02d:%02d", F.floor(t / 3600), F.floor(t % 3600 / 60), t % 60).alias("time")).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_chapters(chapters: DataFrame, path: str) -> None:
    """Chapter lines as M:SS or H:MM:SS and title, one folder a recording."""
    t = F.floor("start_s").cast("long")
    stamp = F.when(t >= 3600, F.format_string("%d:%02d:%02d", F.floor(t / 3600), F.floor(t % 3600 / 60), t % 60)).otherwise(F.format_string("%d:%02d", F.floor(t / 60), t % 60))
    joined = chapters.withColumn("c", F.concat_ws(" ", stamp, "title")).groupBy("recording_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_s", "c"))), lambda x: x["c"]), "\n").alias("value"))
    joined.write.partitionBy("recording_id").mode("overwrite").text(path)


def write_report(rows: DataFrame, path: str) -> None:
    """Rows as JSON."""
    rows.write.mode("overwrite").json(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    """Finished jobs, whatever their outcome, behind those of before."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def _ledger_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job facts written as a ledger with cut lines among them, and read again."""
    path = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    facts = fixtures.view(spark, sf_dir, "job_facts").select("seq", F.col("job_key").alias("key"), "status", F.col("duration_seconds").alias("duration"), F.col("quality_score").alias("quality"), F.lit(1).alias("unknown_field"))
    append_ledger(facts, path)
    facts.select(F.substring(F.to_json(F.struct("*")), 1, 9).alias("value")).write.mode("append").text(path)
    return read_ledger(spark, path).select("seq", "key", "status", "duration", "quality")


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    json = F.format_string('{"format":{"duration":"%d.5"},"streams":[{"codec_type":"video","codec_name":"h264","width":1280,"height":720,"avg_frame_rate":"%d/1001","side_data_list":[{"rotation":%d}]},{"codec_type":"audio"}]}', F.col("p_size"), F.col("p_partkey") * 1000, (F.col("p_partkey") % 4).cast("int") * 90)
    return probe_facts(parts.select("p_partkey", json.alias("json"))).select("p_partkey", "duration_seconds", "width", "height", F.round("fps", 6).alias("fps"), "has_audio")


def _study_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    body = F.concat(F.lit('{"questions":[{"question":"q'), F.col("item_id").cast("string"), F.lit('","kind":"'), F.when(F.col("item_id") % 3 == 0, "essay").otherwise("short"), F.lit('","difficulty":"hard","s":["1","x","'), F.col("item_id").cast("string"), F.lit('"]}]}'))
    reply = F.when(F.col("item_id") % 4 == 0, body).when(F.col("item_id") % 4 == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).when(F.col("item_id") % 4 == 2, F.concat(F.lit("Sure. "), body)).otherwise(F.lit("no json here"))
    parsed = parse_replies(items.select("item_id", reply.alias("reply")), "questions array<struct<question: string, kind: string, difficulty: string, s: array<string>>>")
    return explode_study_replies(parsed).select("item_id", "question", "kind", "difficulty", F.size("segment_ids").cast("long").alias("sources"))


def queries() -> dict:
    return {"ledger_round_trip": _ledger_round_trip, "probe_facts": _probes, "study_replies": _study_replies, "study_items": _study_items}


def oracle_sql() -> dict[str, str]:
    facts = fixtures.DUCK["job_facts"]
    return {
        "ledger_round_trip": f"WITH job_facts AS ({facts}) SELECT seq, job_key AS key, status, duration_seconds AS duration, quality_score AS quality FROM job_facts",
        "probe_facts": "SELECT p_partkey, p_size + 0.5 AS duration_seconds, CASE WHEN p_partkey % 2 = 1 THEN 720 ELSE 1280 END AS width, CASE WHEN p_partkey % 2 = 1 THEN 1280 ELSE 720 END AS height, round(p_partkey * 1000 / 1001.0, 6) AS fps, true AS has_audio FROM part",
        "study_items": """
WITH b AS (SELECT item_id, regexp_replace(regexp_replace(text, '[\\\\"]', ' ', 'g'), '\\s', ' ', 'g') AS t FROM benchmark WHERE text IS NOT NULL)
SELECT item_id, 'objective' AS item_type, 0 AS item_idx, substr(t, 1, 30) AS front, '' AS back, NULL AS kind, NULL AS difficulty, NULL AS options, NULL AS explanation, '1,2' AS segment_ids FROM b
UNION ALL SELECT item_id, 'glossary', 0, substr(t, 5, 12), '', NULL, NULL, NULL, NULL, '' FROM b
UNION ALL SELECT item_id, 'question', 0, substr(t, 2, 40), 'true', 'short', 'medium', '1|b|', 'since', '' FROM b
UNION ALL SELECT item_id, 'flashcard', 0, substr(t, 9, 20), '12', NULL, NULL, NULL, NULL, '' FROM b""",
        "study_replies": "SELECT item_id, 'q' || CAST(item_id AS VARCHAR) AS question, CASE WHEN item_id % 3 = 0 THEN 'mcq' ELSE 'short' END AS kind, 'hard' AS difficulty, CAST(2 AS BIGINT) AS sources FROM benchmark WHERE item_id % 4 <> 3",
    }


def read_eval_set(spark: SparkSession, manifest: str, references: str) -> DataFrame:
    """Clips with their reviewed references; the two files must be of one evaluation."""
    clips = spark.read.option("multiLine", True).schema("eval_id string, clips array<struct<name: string, source: string, start: double, duration: double, hyp: string>>").json(manifest)
    refs = spark.read.option("multiLine", True).schema("eval_id string, clips map<string, struct<text: string, reviewed: boolean, exclude: boolean>>").json(references)
    if clips.select("eval_id").first() != refs.select("eval_id").first():
        raise ValueError("the references are of another evaluation")
    rows = clips.join(refs.withColumnRenamed("clips", "refs"), "eval_id").select(F.explode("clips").alias("c"), "refs")
    return rows.select("c.*", F.col("refs")[F.col("c.name")].alias("ref"))


def watch_inbox(spark: SparkSession, folder: str, ledger: str, checkpoint: str) -> None:
    """Take in every new media file of a folder once and add it to the ledger; empty files are passed over."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("at"), F.lit("taken").alias("status"))
    media = named.filter(F.lower(F.element_at(F.split("name", "[.]"), -1)).isin(*VIDEO, *AUDIO))

    def note(rows: DataFrame, _: int) -> None:
        append_ledger(rows.dropDuplicates(["name", "size", "at"]), ledger)

    media.writeStream.foreachBatch(note).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
