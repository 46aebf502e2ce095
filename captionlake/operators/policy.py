"""Checks over catalogues of files and texts, and choices among candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names that are never published, markers of secrets and of private folders.
FORBIDDEN_NAMES = (
    ".netrc", "_netrc", ".npmrc", ".pypirc", "credentials", "credentials.json", "secrets.json", "service-account.json", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519",
)
KEY_MARKERS = ("-----BEGIN " + "PRIVATE KEY-----", "-----BEGIN OPENSSH " + "PRIVATE KEY-----")
SECRET_PATTERNS = (("cloudKey", "AK" + "IA[0-9A-Z]{16}"), ("token", "gh" + "[ps]_[A-Za-z0-9]{30,}"), ("fineToken", "github_pat" + "_[A-Za-z0-9_]{30,}"))
PRIVATE_FOLDERS = ("/Users/", "/home/", "/private/var/folders/")
PRIVATE_NAMES = ("PROJECT_MEMORY", "_PROJECT_AUDIT", "_PROJECT_RESEARCH", "_PRIVATE_CHATS")
SCANNED_BYTES = 8 << 20


def scan_files(files: DataFrame) -> DataFrame:
    """(path, problem): a row for a forbidden name, and one for the first kind of secret in a file's content; contents over 8
    MiB are judged by name only."""
    small = F.octet_length("text") <= SCANNED_BYTES
    name = F.when(F.lower(F.substring_index("path", "/", -1)).isin(*FORBIDDEN_NAMES), "forbiddenName")
    secret = F.when(small & (F.col("text").contains(KEY_MARKERS[0]) | F.col("text").contains(KEY_MARKERS[1])), "privateKey")
    for kind, pattern in SECRET_PATTERNS:
        secret = secret.when(small & F.col("text").rlike(pattern), kind)
    return files.select("path", F.explode(F.array_compact(F.array(name, secret))).alias("problem"))


def scan_private_folders(files: DataFrame) -> DataFrame:
    """(path, marker): private folders that a text names, and parts that a file's own name must not have."""
    name = F.substring_index("path", "/", -1)
    places = [(F.col("text"), m) for m in PRIVATE_FOLDERS] + [(name, m) for m in PRIVATE_NAMES]
    found = F.array_compact(F.array(*[F.when(where.contains(m), F.lit(m)) for where, m in places]))
    return files.select("path", F.explode(found).alias("marker"))


def build_manifest(files: DataFrame, own: str = "manifest.json") -> DataFrame:
    """Path, size and hash of every file but the manifest; unsafe paths (absolute, with ..) are left out."""
    unsafe = F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), "..")
    raw = F.col("text").cast("binary")
    return files.where(~unsafe & (F.col("path") != own)).select("path", F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("sha"))


def catalogue_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one side only."""
    side = lambda x, y, name: x.join(y.select(key), key, "left_anti").select(key, F.lit(name).alias("side"))
    return side(a, b, "first").unionByName(side(b, a, "second"))


def two_best(rows: DataFrame, keys: list[str], place: str, score: str, name: str) -> DataFrame:
    """The best candidate of each key, its score and the runner-up's (0 if none); ties keep the input order."""
    order = F.struct((-F.col(score)).alias("s"), F.col(place).alias("p"), F.col(name).alias("n"))
    best = F.slice(F.array_sort(F.collect_list(order)), 1, 2)
    grouped = rows.groupBy(keys).agg(best.alias("b"))
    return grouped.select(*keys, F.get("b", F.lit(0))["n"].alias(name), (-F.get("b", F.lit(0))["s"]).alias("best"), F.coalesce(-F.get("b", F.lit(1))["s"], F.lit(0.0)).alias("runner_up"))


def duplicates(rows: DataFrame, key: Column) -> DataFrame:
    """Rows whose key another row has too. A partial count first, so that a common key isn't one task's window."""
    keyed = rows.withColumn("__key", key)
    many = keyed.groupBy("__key").agg(F.count("*").alias("n")).where("n > 1").select("__key")
    return keyed.join(many, "__key", "left_semi").withColumnRenamed("__key", "reserved")


def retry_units(requests: DataFrame, responses: DataFrame, damage: Column) -> DataFrame:
    """(batch, unit_id, verdict): a batch with an unknown or repeated id fails whole; in the others a missing or
    damaged unit is asked for again."""
    key = ["batch", "unit_id"]
    got = responses.withColumn("damage", damage).groupBy(key).agg(F.count("*").alias("n"), F.max("damage").alias("damage"))
    both = requests.select(*key, F.lit(1).alias("asked")).join(got, key, "full_outer")
    broken = both.where("asked is null or n > 1").select("batch").distinct()
    failed = broken.select("batch", F.lit(None).cast("long").alias("unit_id"), F.lit("failed").alias("verdict"))
    again = both.join(broken, "batch", "left_anti").where("n is null or damage is not null").select(*key, F.lit("retry").alias("verdict"))
    return failed.unionByName(again)


def log_tail(lines: DataFrame, event_prefix: str, keep: int = 120, n_bytes: int = 16_384) -> DataFrame:
    """The newest lines of each source: blank, event and consecutively repeated ones aside, and of these the
    last bytes, cut between characters. The limits are the feature."""
    order = Window.partitionBy("media_id").orderBy("i")
    told = lines.withColumn("t", F.regexp_replace("t", r"^[ \t]+|[ \t]+$", "")).where((F.col("t") != "") & ~F.col("t").startswith(event_prefix))
    told = told.withColumn("last", F.lag("t").over(order)).where(~F.col("t").eqNullSafe(F.col("last")))
    told = told.withColumn("n", F.row_number().over(Window.partitionBy("media_id").orderBy(F.desc("i")))).where(F.col("n") <= keep)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]), "\n")
    joined = told.groupBy("media_id").agg(text.alias("text"))
    cut = F.unhex(F.regexp_replace(F.right(F.hex(F.col("text").cast("binary")), F.lit(2 * n_bytes)), "^(?:[89AB][0-9A-F])+", ""))
    whole = F.octet_length("text") <= n_bytes
    return joined.select("media_id", F.when(whole, F.col("text")).otherwise(cut.cast("string")).alias("tail"))


def bounded_log(entries: DataFrame, limit: int = 8000) -> DataFrame:
    """The newest entries of each source within so many characters, one at least. The limit is the feature."""
    newest = Window.partitionBy("media_id").orderBy(F.desc("i"))
    used = entries.withColumns({"used": F.sum(F.length("t")).over(newest), "n": F.row_number().over(newest)})
    return used.where((F.col("used") <= limit) | (F.col("n") == 1)).select("media_id", "i", "t")


def framed(chunks: DataFrame, longest: int = 65_536) -> DataFrame:
    """Lines of each source's chunks, ended by CR, LF or both, also across chunks; a source with a longer line
    than allowed gives one row with failed."""
    whole = chunks.groupBy("media_id").agg(F.expr("listagg(chunk) WITHIN GROUP (ORDER BY p)").alias("all"))
    lines = whole.select("media_id", F.split(F.regexp_replace("all", r"(\r\n|\r|\n)$", ""), r"\r\n|\r|\n").alias("ls"))
    failed = F.exists("ls", lambda x: F.octet_length(x) > longest)
    return lines.select("media_id", failed.alias("failed"), F.posexplode(F.when(failed, F.array(F.lit(None).cast("string"))).otherwise(F.col("ls"))).alias("p", "line"))


def bill_issues(lock: DataFrame, listed: DataFrame, bill: DataFrame) -> DataFrame:
    """(place, name, issue) of the components of a bill of materials, each judged by the lock and the listed licenses.

    lock: name, version, hashes; listed: name, license; bill: place, name, version, purl, ref, hashes, licenses (arrays; null
    is empty). Names are compared in lower case, with runs of `-`, `_` and `.` as `-`. A component without a name, or whose
    name one at a lower place has, is a duplicate, and one that isn't locked is notLocked; neither is judged further. Of
    repeated names in lock or listed, the largest version or license counts. A null version is empty."""
    name = F.regexp_replace(F.lower(F.coalesce("name", F.lit(""))), "[-_.]+", "-")
    whole = lambda c: F.array_distinct(F.array_compact(F.coalesce(F.col(c), F.array().cast("array<string>"))))
    locked = lock.groupBy(name.alias("name")).agg(F.max("version").alias("locked"), F.max_by("hashes", "version").alias("allowed"))
    known = listed.groupBy(name.alias("name")).agg(F.max("license").alias("license"))
    rows = bill.select("place", name.alias("name"), F.coalesce("version", F.lit("")).alias("version"), "purl", "ref", whole("hashes").alias("hashes"), whole("licenses").alias("licenses"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy("place")))
    rows = rows.join(locked, "name", "left").join(known, "name", "left")
    wanted = F.concat(F.lit("pkg:pypi/"), "name", F.lit("@"), "version")
    same = F.col("version") == F.col("locked")
    allowed = F.when(same, F.coalesce("allowed", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    judged = F.array(
        F.when(~same, "versionMismatch"), F.when(~(F.col("purl").eqNullSafe(wanted) & F.col("ref").eqNullSafe(wanted)), "referenceMismatch"),
        F.when((F.size("hashes") != 1) | (F.size(F.array_except("hashes", allowed)) > 0), "hashNotLocked"),
        F.when((F.size("licenses") != 1) | (F.get("licenses", F.lit(0)) != F.coalesce("license", F.lit(""))), "licenseMismatch"),
    )
    found = F.when((F.col("name") == "") | (F.col("nth") > 1), F.array(F.lit("duplicateComponent"))).when(F.col("locked").isNull(), F.array(F.lit("notLocked"))).otherwise(F.array_compact(judged))
    return rows.select("place", "name", F.explode(found).alias("issue"))


def three_way(lock: DataFrame, listed: DataFrame, bill: DataFrame) -> DataFrame:
    """(name, issue) of names that not all three inventories have once and in the same version. One grouping of
    the union takes the place of two full joins."""
    sides = {"lock": lock, "listed": listed, "bill": bill}
    tagged = [rows.select("name", "version", F.lit(s).alias("side")) for s, rows in sides.items()]
    n = {s: F.count_if(F.col("side") == s).alias(s) for s in sides}
    counted = tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).groupBy("name").agg(*n.values(), F.min("version").alias("low"), F.max("version").alias("high"))
    issues = [F.when(F.col(s) == 0, f"missing:{s}") for s in sides] + [F.when(F.col(s) > 1, f"duplicate:{s}") for s in sides] + [F.when(F.col("low") != F.col("high"), "versionMismatch")]
    return counted.select("name", F.explode(F.array_compact(F.array(*issues))).alias("issue"))
