"""Small tables that queries and their SQL share, and views of the test tables as an index would see them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, float)):
        return repr(x)
    if isinstance(x, list):
        return "[" + ", ".join(map(_literal, x)) + "]"
    return "'" + str(x).replace("'", "''") + "'"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table expression of DuckDB with ``rows``."""
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + ")"


def fed(spark: SparkSession, sf_dir: str, name: str, schema: str, rows: list[tuple], given: list[str]) -> DataFrame:
    """Stated ``rows`` and, for each row of a test table, what the expressions ``given`` make of it, which Spark and DuckDB read alike."""
    kinds = [x.rsplit(" ", 1) for x in schema.split(", ")]
    more = table(spark, sf_dir, name).selectExpr(*(f"CAST({e} AS {kind}) AS {column}" for e, (column, kind) in zip(given, kinds, strict=True)))
    return spark.createDataFrame(rows, schema).unionByName(more)


def fed_sql(cte: str, name: str, columns: str, rows: list[tuple], given: list[str]) -> str:
    """The same as a common table expression."""
    return f"{values(cte + '_stated', columns, rows)}, {cte}({columns}) AS (SELECT * FROM {cte}_stated UNION ALL SELECT {', '.join(given)} FROM {name})"


#: What a search looks into: the vectors, with paths, entities and flags that their numbers give.
def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    i, label = F.col("vec_id"), F.col("label")
    ending = F.when(i % 3 == 0, ".h").when(i % 3 == 1, ".cpp").otherwise(".txt")
    name = F.concat(F.when(i % 2 == 0, "Wheel").otherwise("Hit"), F.lit("Part"), (i % 50).cast("string"), ending)
    entities = F.when(i % 5 == 0, F.array(F.concat(F.lit("FHit"), label.cast("string")), F.lit("UWheel"), F.lit("AActor"), F.lit("EMode"))).otherwise(F.array(F.concat(F.lit("FHit"), label.cast("string"))))
    return v.select(
        i.alias("chunk_id"), F.concat(F.lit("/Source/Runtime/M"), label.cast("string"), F.lit("/Public/"), name).alias("path"), F.when(label < 5, "engine").otherwise("project").alias("origin"),
        (i % 4).cast("int").alias("chunk_index"), F.lit(4).alias("total_chunks"), entities.alias("entities"), F.array(F.when(label % 2 == 0, "struct").otherwise("class")).alias("entity_types"),
        (i % 4 == 0).alias("has_uproperty"), (i % 6 == 0).alias("has_ufunction"), (i % 7 == 0).alias("has_uclass"), F.lit(False).alias("has_ustruct"), F.lit(False).alias("has_uenum"),
        (i % 3 == 0).alias("is_header"), (i % 3 == 1).alias("is_implementation"), "embedding")


STORE = """store AS (SELECT vec_id AS chunk_id,
  '/Source/Runtime/M' || label || '/Public/' || CASE WHEN vec_id % 2 = 0 THEN 'Wheel' ELSE 'Hit' END || 'Part' || vec_id % 50 || CASE vec_id % 3 WHEN 0 THEN '.h' WHEN 1 THEN '.cpp' ELSE '.txt' END AS path,
  CASE WHEN label < 5 THEN 'engine' ELSE 'project' END AS origin, (vec_id % 4)::INT AS chunk_index,
  CASE WHEN vec_id % 5 = 0 THEN ['FHit' || label, 'UWheel', 'AActor', 'EMode'] ELSE ['FHit' || label] END AS entities,
  [CASE WHEN label % 2 = 0 THEN 'struct' ELSE 'class' END] AS entity_types,
  vec_id % 4 = 0 AS has_uproperty, vec_id % 6 = 0 AS has_ufunction, vec_id % 7 = 0 AS has_uclass, false AS has_ustruct,
  vec_id % 3 = 0 AS is_header, vec_id % 3 = 1 AS is_implementation, embedding::DOUBLE[] AS embedding FROM embeddings)"""


def vector_of(rows: DataFrame, label: int = 0) -> list[float]:
    """The vector of a label's smallest id: one row on the driver."""
    return rows.where(F.col("label") == label).agg(F.min_by("embedding", "vec_id")).first()[0]


#: Documents as source files.
def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    ending = F.when(n % 4 == 0, ".md").when(n % 4 == 1, ".cpp").when(n % 4 == 2, ".h").otherwise(".json")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), ending))
    return d.select("doc_id", path.alias("path"), F.when(n < 10, "engine").otherwise("project").alias("origin"), F.coalesce("text", F.lit("")).alias("text"))


FILES = r"""files AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || CASE regexp_extract(source, '(\d+)$', 1)::INT % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.cpp' WHEN 2 THEN '.h' ELSE '.json' END AS path,
  CASE WHEN regexp_extract(source, '(\d+)$', 1)::INT < 10 THEN 'engine' ELSE 'project' END AS origin, coalesce(text, '') AS text FROM documents)"""

#: Snippets of code: path, origin, text.
CODE = [
    ("/eng/Source/Runtime/Phys/Public/Hit.h", "engine", '#pragma once\n#include "CoreMinimal.h"\n#include <vector>\n\nUSTRUCT(BlueprintType)\nstruct ENGINE_API FHitInfo\n{\n\tGENERATED_BODY()\n\tUPROPERTY(EditAnywhere)\n\tFVector Point;\n\tUPROPERTY()\n\tUSceneComponent* Part;\n\tfloat Time;\n\tFName Label; // shown\n};\n'),
    ("/eng/Source/Runtime/Game/Classes/Sub/Actor.h", "engine", '#include "Hit.h"\n\nUCLASS(Abstract)\nclass GAME_API AThing : public AActor, public IUsable\n{\n\tGENERATED_BODY()\npublic:\n\tUPROPERTY()\n\tTArray<FHitInfo> Hits;\n\tUFUNCTION()\n\tvirtual void Use(int32 Count, FName Why);\n\tUWheelComponent* Wheel;\n};\n'),
    ("/eng/Source/Runtime/Game/Private/Actor.cpp", "engine", '#include "Sub/Actor.h"\n#include "Hit.h"\n\nvoid AThing::Use(int32 Count, FName Why)\n{\n\tconst char* s = "a } in a string";\n\t// and { in a comment\n\tif (Count > 0) { Hits.Reset(); }\n}\n\nstatic int32 Twice(int32 X)\n{\n\treturn 2 * X;\n}\n'),
    ("/eng/Source/Runtime/Phys/Public/Channel.h", "engine", "UENUM()\nenum class EChannel : uint8\n{\n\tVisible,\n\tCamera = 2,\n\tHidden\n};\n\nenum ELegacy\n{\n\tOld_A,\n\tOld_B\n};\n"),
    ("/proj/Source/Wheels/Plain.h", "project", "struct FPlain { int32 A; FVector B; };\nclass UOwner : public UObject { FPlain Item; };\nDECLARE_DYNAMIC_MULTICAST_DELEGATE_OneParam(FOnHit, float, Force);\n"),
    ("/proj/Source/Wheels/Public/Deep/Er/Wheel.h", "project", '\n\n\nUCLASS()\nclass UWheelComponent : public UActorComponent\n{\n\tUPROPERTY()\n\tFPlain Plain;\n\tUPROPERTY()\n\tUWheelComponent* Twin;\n};\n'),
    ("/proj/Source/Wheels/notes.txt", "project", "How wheels work. No code here, but struct is a word.\n"),
    ("/proj/empty.h", "project", ""),
]


#: What stands before the text of a document that is a .h or .cpp file: a struct and a class of its own.
OWN_CODE = "struct FDoc{}\n{\n\tFVector Place;\n\tUDoc{}* Next;\n};\nclass UDoc{} : public UObject\n{\n\tUPROPERTY()\n\tFDoc{} Item;\n};\n"


def code(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    """The snippets, and with ``sf_dir`` all documents as files, each source file with code of its own."""
    snippets = spark.createDataFrame(CODE, "path string, origin string, text string")
    if sf_dir is None:
        return snippets
    parts = OWN_CODE.split("{}")
    own = F.concat(F.lit(parts[0]), *(x for p in parts[1:] for x in (F.col("doc_id").cast("string"), F.lit(p))))
    text = F.when(F.col("path").rlike(r"\.(h|cpp)$"), F.concat(own, "text")).otherwise(F.col("text"))
    return snippets.unionByName(files(spark, sf_dir).select("path", "origin", text.alias("text")))


CODE_SQL = f"""{FILES}, {values("snippets", "path, origin, text", CODE)},
code AS (SELECT path, origin, text FROM snippets UNION ALL SELECT path, origin, CASE WHEN regexp_matches(path, '\\.(h|cpp)$') THEN replace({_literal(OWN_CODE)}, '{{}}', doc_id::VARCHAR) ELSE '' END || text FROM files)"""

QUESTIONS = [
    "struct FHitResult", "FHitResult struct", "definition of FHitResult", "define FHitResult", "what is FHitResult", "class AActor", "AActor class", "show me AActor", "define AActor",
    "find ECollisionChannel", "show me FVector", "FVector", "AActor", "LineTraceSingleByChannel function", "FHitResult members", "AActor methods", "LineTraceSingleByChannel parameters",
    "how does garbage collection work", "explain replication", "best practices for networking", "FVector math calculation", "list ECollisionChannel values please", "The FVector usage is amazing",
    "", "   ", "where is the header of the wheel", "vector", "char mov", "trace hit", "which file has UWheelComponent", "function Tick", "physics constraint for FBodyInstance setup today",
]
QUESTION_ROWS = [(i, q) for i, q in enumerate(QUESTIONS)]


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTION_ROWS, "query_id long, question string")


QUESTIONS_SQL = values("questions", "query_id, question", QUESTION_ROWS)
