"""Generated, minified, vendored and data files among source files (problem 3).

A random forest over compression ratio, token entropy, identifier lengths and
comment density decides by content. Its labels are header notices, whose lines
the features never see. Notices and paths of foreign code follow as an exact
check, because copied code reads like any other.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hewn.session import bounded_batches, cut

#: Bound of the labelled sample that the forest is fitted on.
MAX_LABELLED = 50_000

# Notices (Java and Python regex), for the first lines of a file.
GENERATED_NOTICE = (
    r"(?i)code generated by\b|\bauto-?generated (?:file|by|from|code)\b|@generated\b|generated (?:source|file|code)\b.*do not|\bmachine[- ](?:made|generated|written)\b"
    r"|generated from (?:the|a) .{0,60}(?:grammar|schema|template|specification|definition)|(?:produced|generated|created) automatically|automatically (?:generated|produced|created)"
    r"|automatisch (?:erzeugt|generiert)|généré automatiquement|generado automáticamente|do not (?:hand-?)?(?:edit|modify)\b|自動生成|自动生成"
)
BANNER = r"^\s*/\*! \S+ v\d+(?:\.\d+)+ \*/\s*$"
_ASSET = r"(?:icons?|fonts?|glyphs?|sprites?|images?|assets?|data|tables?|lookup \w+)"
DATA_NOTICE = rf"(?i)^\W*(?:(?:embedded|packed|encoded|inlined) )?{_ASSET}(?:(?:, | and ){_ASSET})* for\b"
FOREIGN_NOTICE = (
    r"(?i)^\W*vendored (?:from|copy)\b|copied (?:verbatim|unchanged) from|third-party source|^\W*upstream: .*without changes|\bsee upstream for the licen[cs]e"
    r"|imported (?:verbatim|unchanged) from|\b(?:aus|von) .{1,60} (?:übernommen|kopiert)|\b(?:copié|repris) (?:de|du)\b|\b(?:copiado|tomado) (?:de|del)\b"
)
HAND_NOTICE = (
    r"(?i)\bnot (?:auto-?)?generated\b|\b(?:nothing|none|no part)\b.{0,20}\bgenerated\b|\bwritten by hand\b|\bhand-?written\b|\bideas? (?:\w+ )?from\b|\binspired by\b"
    r"|\b\w+ that (?:is|are|get) generated\b|spdx-license|^\W*copyright \d{4} the"
)
#: Lines of a file that may hold its header notice: a chunk's leading comment is a header if the chunk begins there.
HEAD_LINES = 12
#: Code points that a labelled file must have; shorter ones teach nothing about content.
LABEL_TEXT = 60

# Directories of foreign code and endings of generated files, on lower-case paths with forward slashes.
FOREIGN_PATH = r"(?:^|/)(?:node_modules|bower_components|jspm_packages|vendor|vendored|_vendor|third_party|thirdparty|third-party|pods|extern|external_libs|site-packages)/"
GENERATED_PATH = r"(?:_pb2(?:_grpc)?\.pyi?|[._]pb\.(?:js|ts|go|py|rs|java|cc|h)|_pb\.d\.ts|[.-]min\.m?js|\.bundle\.m?js|[._]gen\.\w+|\.generated\.\w+|\.g\.\w+|_generated\.(?:deepcopy\.)?\w+)$"

FEATURES = [
    "compression", "token_entropy", "type_token", "identifier_length", "one_letter", "comment_density", "line_length", "longest_line", "digits",
    "line_shapes", "numbered", "quoted",
]

_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d+|[^\s\w]")
_COMMENT_LINE = re.compile(r"^[ \t]*(?:#(?!\[|!\[)|//|/\*|\*).*$", re.M)
_LEADING = re.compile(r"\A\s*(?:(?:#(?!\[|!\[)[^\n]*|//[^\n]*|/\*[\s\S]*?\*/)\s*)+")
_SHAPE = re.compile(r"\w+")
_QUOTED = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'")
_NUMBERED = re.compile(r"\d{2,}\b")


def normal_path(c):
    """A path in lower case, with forward slashes and without leading dots."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"\\", "/"), r"^(?:\./)+|/(?=/)", "")


def features(content: str) -> tuple[float, ...]:
    """The features of one chunk's content, without its leading comments."""
    text = _LEADING.sub("", content)
    size = len(text)
    if not size:
        return (0.0,) * len(FEATURES)
    raw = text.encode("utf-8", "replace")
    tokens = _TOKEN.findall(text)
    counts = Counter(tokens)
    n = max(1, len(tokens))
    entropy = math.log2(n) - sum(k * math.log2(k) for k in counts.values()) / n
    names = [(len(t), k) for t, k in counts.items() if t[0].isalpha() or t[0] in "_$"]
    m = max(1, sum(k for _, k in names))
    lines = [x for x in text.split("\n") if x.strip()] or [""]
    shapes = len({_SHAPE.sub("w", x) for x in lines})
    return (
        len(zlib.compress(raw, 1)) / len(raw),
        entropy,
        len(counts) / n,
        sum(a * k for a, k in names) / m,
        sum(k for a, k in names if a == 1) / m,
        sum(len(x) for x in _COMMENT_LINE.findall(text)) / size,
        min(2000.0, size / len(lines)),
        float(min(20000, max(map(len, lines)))),
        sum(len(t) * k for t, k in counts.items() if t[0].isdigit()) / size,
        shapes / len(lines),
        len(_NUMBERED.findall(text)) / n,
        sum(map(len, _QUOTED.findall(text))) / size,
    )


def file_features(chunks: DataFrame) -> DataFrame:
    """One row per file with its features (means over its chunks, weighted by length) and the notices of its first lines.

    Features are computed where the chunk is read and only sums are shuffled.
    Null content counts as absent.
    """
    bounded_batches(chunks.sparkSession)
    src = chunks.select(F.col("file_id").cast("long"), F.col("start_line").cast("int"), F.lower("kind").alias("kind"), "content")
    notices = [re.compile(x, re.M) for x in (GENERATED_NOTICE, BANNER, DATA_NOTICE, FOREIGN_NOTICE, HAND_NOTICE)]
    flags = ["generated", "banner", "data", "foreign", "hand"]
    names = ["file_id", "weight", *FEATURES, *flags]
    types = [pa.int64(), *[pa.float64()] * (1 + len(FEATURES)), *[pa.int8()] * len(flags)]

    def run(batches):
        for b in batches:
            rows = []
            for file, line, kind, content in zip(*b.to_pydict().values()):
                if file is None:
                    continue
                content = (content or "").replace("\r\n", "\n").replace("\r", "\n")
                head = ""
                if (line or 0) <= HEAD_LINES:
                    m = _LEADING.match(content)
                    head = m[0] if m else ""
                said = [int(bool(head and x.search(head))) for x in notices]
                values = features(content) if content and kind not in ("import", "comment") else (0.0,) * len(FEATURES)
                w = float(len(content)) if any(values) else 0.0
                rows.append((file, w, *(v * w for v in values), *said))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(names), types)], names=names)

    schema = "file_id long, weight double, " + ", ".join(f"{x} double" for x in FEATURES) + ", " + ", ".join(f"{x} tinyint" for x in flags)
    w = F.sum("weight")
    return (
        src.mapInArrow(run, schema)
        .groupBy("file_id")
        .agg(w.alias("weight"), *[F.when(w > 0, F.sum(x) / w).otherwise(0.0).alias(x) for x in FEATURES], *[(F.max(x) > 0).alias(x) for x in flags])
    )


def labelled(files: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """Files whose first lines say how they were made: 1 by a tool, 0 by hand; at most about ``bound`` of them, chosen by hash."""
    made = F.col("generated") | F.col("banner") | F.col("data")
    rows = files.filter(F.col("weight") >= LABEL_TEXT).withColumn("label", F.when(made, 1.0).when(F.col("hand") & ~F.col("foreign"), 0.0)).filter("label is not null")
    n = rows.count()
    return rows if n <= bound else rows.filter(F.pmod(F.xxhash64("file_id"), F.lit(1_000_000)) < int(1_000_000 * bound / n))


def forest(files: DataFrame, seed: int = 7):
    """The fitted forest, or null where labels of both classes are lacking. Labels that the first fit contradicts clearly are left out of the second."""
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
    train = cut(vectors.transform(labelled(files)).select("features", "label"))
    seen = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    if min(seen.get(0.0, 0), seen.get(1.0, 0)) < 5:
        return None
    share = seen[0.0] / seen[1.0]
    train = train.withColumn("w", F.when(F.col("label") == 1, min(20.0, max(1.0, share / 3))).otherwise(1.0))
    grow = RandomForestClassifier(numTrees=24, maxDepth=8, minInstancesPerNode=2, seed=seed, weightCol="w", featureSubsetStrategy="sqrt")
    first = grow.fit(train)
    kept = first.transform(train).filter(F.abs(vector_to_array("probability")[1] - F.col("label")) < 0.8).select("features", "label", "w")
    return grow.fit(kept)


#: Probability from which the forest alone calls a file not written by hand, and below which a generated file's path is not believed.
THRESHOLD, DOUBT = 0.4, 0.15


def by_forest(files: DataFrame) -> DataFrame:
    """``files`` with the forest's ``probability``: null for files without content, and for all where labels of both classes are lacking."""
    model = forest(files)
    if model is None:
        return files.withColumn("probability", F.lit(None).cast("double"))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
    return model.transform(vectors.transform(files)).withColumn("probability", F.when(F.col("weight") > 0, vector_to_array("probability")[1]))


def forest_verdicts(chunks: DataFrame) -> DataFrame:
    """(file_id, probability, by_tool) of every file with a chunk by the forest alone; files without content have null for both. Empty tables give no rows."""
    by = by_forest(cut(file_features(chunks)))
    return by.select("file_id", "probability", (F.col("probability") >= THRESHOLD).alias("by_tool"))


def scored(chunks: DataFrame, git_files: DataFrame, threshold: float = THRESHOLD, doubt: float = DOUBT) -> DataFrame:
    """One row per file of either table: (file_id, probability, made, foreign_notice, foreign_path, made_path, found).

    ``probability`` is the forest's (null for files without content), ``found`` the
    verdict; a path like that of a generated file counts unless the content
    contradicts it (``doubt``). Null paths and contents count as no evidence; repeated snapshots
    and copies of a chunk add nothing new. Empty tables give no rows.
    """
    files = cut(file_features(chunks))
    paths = (
        chunks.select(F.col("file_id").cast("long"), F.col("rel_path").alias("path"))
        .unionByName(git_files.select(F.col("file_id").cast("long"), "path"))
        .filter("file_id is not null")
        .withColumn("path", normal_path("path"))
        .groupBy("file_id")
        .agg(F.max(F.col("path").rlike(FOREIGN_PATH)).alias("foreign_path"), F.max(F.col("path").rlike(GENERATED_PATH)).alias("made_path"))
    )
    by = by_forest(files)
    out = paths.join(by, "file_id", "left")
    made = F.coalesce(F.col("generated") | F.col("banner") | F.col("data"), F.lit(False))
    foreign = F.coalesce(F.col("foreign"), F.lit(False))
    verdict = made | foreign | F.coalesce("foreign_path", F.lit(False)) | (F.coalesce("made_path", F.lit(False)) & (F.coalesce("probability", F.lit(1.0)) >= doubt)) | F.coalesce(F.col("probability") >= threshold, F.lit(False))
    return out.select("file_id", "probability", made.alias("made"), foreign.alias("foreign_notice"), "foreign_path", "made_path", verdict.alias("found"))


def not_handwritten(chunks: DataFrame, git_files: DataFrame) -> DataFrame:
    """(file_id) of each file that nobody wrote by hand for the project."""
    return scored(chunks, git_files).filter("found").select("file_id")
