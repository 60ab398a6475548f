"""Question analysis as columns: what a question asks for, which entity, and how to search for it."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import kind_of, list_of, lists_by

# Patterns of questions that ask for a definition, tried in this order.
KIND_NAME = r"\b(struct|class|enum)\s+([A-Z_]\w+)"
NAME_KIND = r"\b([A-Z_]\w+)\s+(struct|class|enum)"
DEFINE_NAME = r"\b(define|definition\s+of)\s+([A-Z_]\w+)"
ASK_NAME = r"\b(what\s+is|show\s+me|find)\s+([A-Z_]\w+)"
NAME_FUNCTION = r"\b([A-Z]\w+)\s+function"
FUNCTION_NAME = r"\bfunction\s+([A-Z]\w+)"
# Words in front of a name that aren't a name themselves.
LEADING = ["struct", "class", "enum", "define", "definition", "what", "show", "find"]
# Keywords, looked for anywhere in the lower-case question, inside words too.
CONCEPTUAL = ["how", "why", "when", "explain", "describe", "difference between", "compare", "best practice", "example", "tutorial", "guide", "work", "works", "working"]
FILE = ["file", "location", "path", "where is", "find the file", "header", "source", "directory", "folder"]
DEFINITION = ["members", "fields", "properties", "methods", "functions", "definition", "declare", "declared", "signature", "parameters", "return type", "inherit", "base class"]
# Words that are no entity although they start with a capital, and that don't count as significant.
NOT_ENTITIES = ["What", "How", "Where", "Who", "When", "Why", "Show", "Find", "Get", "The", "Tell", "Explain", "Describe", "Does", "Is", "Are", "In", "Which", "Please"]
INSIGNIFICANT = ["the", "what", "where", "find", "show", "file"]
# What is added to a question about an entity of a kind, and further words if the question has a hint.
KIND_WORDS = {"struct": ["struct", "UPROPERTY", "fields"], "class": ["class", "UCLASS", "UFUNCTION"], "enum": ["enum", "UENUM"], "function": ["function", "UFUNCTION"]}
HINTS = [("struct", ["member", "field", "propert"], "members"), ("class", ["method", "function"], "methods"), ("enum", ["value"], "values"), ("function", ["param", "arg"], "parameters"), ("function", ["return"], "returns")]

# Why a question is taken as it is; %s are the entity's kind and name, or its name and the kind of keyword.
REASONS = {
    "explicit": "Explicit definition query detected: %s %s",
    "function": "Function definition query detected: %s",
    "bare": "Bare entity name detected: %s %s",
    "hybrid": "Detected entity '%s' with %s keywords, using hybrid search",
    "conceptual": "Conceptual question detected, using semantic search",
    "file": "File/Location query detected",
    "default": "No strong indicators, defaulting to semantic search",
}

INTENT = "struct<type: string, entity_type: string, entity_name: string, confidence: double, enhanced_query: string, is_file_search: boolean, reasoning: string>"


def words(text: Column) -> Column:
    """Split at white space; no empty words."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def has_any(text: Column, keywords: list[str]) -> Column:
    return F.exists(list_of(keywords), lambda k: F.contains(text, k))


def entity_names(question: Column) -> Column:
    """Words with a capital in front, in order, without question words."""
    return F.filter(F.regexp_extract_all(question, F.lit(r"(?U)\b[A-Z]\w+\b"), F.lit(0)), lambda w: ~F.array_contains(list_of(NOT_ENTITIES), w))


def enhance(question: Column, name: Column, kind: Column) -> Column:
    """The question with the words of its entity's kind that it lacks, then the capitalised words that it mentions."""
    low = F.lower(question)
    own = F.coalesce(*(F.when(kind == k, list_of(ws)) for k, ws in KIND_WORDS.items()), F.array().cast("array<string>"))
    more = F.array_compact(F.array(*(F.when((kind == k) & has_any(low, hints), F.lit(word)) for k, hints, word in HINTS)))
    lacking = F.filter(F.concat(own, more), lambda w: ~F.contains(low, F.lower(w)))
    named = F.filter(F.regexp_extract_all(question, F.lit(r"(?U)\b([A-Z][a-z]+(?:[A-Z][a-z]+)*)\b"), F.lit(1)), lambda w: w != name)
    return F.concat_ws(" ", question, F.when(F.size(lacking) > 0, F.array_join(lacking, " ")), F.when(F.size(named) > 0, F.array_join(named, " ")))


def _explicit(q: Column) -> tuple[Column, Column]:
    """(name, keyword) by the first pattern that matches, null if none does."""
    get = lambda p, k: F.regexp_extract(q, "(?iU)" + p, k)
    first = get(NAME_KIND, 1)
    turned = F.array_contains(list_of(LEADING), F.lower(first)) | F.contains(F.lower(first), F.lit("definition"))
    ways = [
        (get(KIND_NAME, 2), get(KIND_NAME, 1)),
        (F.when(turned, get(NAME_KIND, 2)).otherwise(first), F.when(turned, first).otherwise(get(NAME_KIND, 2))),
        (get(DEFINE_NAME, 2), get(DEFINE_NAME, 1)),
        (get(ASK_NAME, 2), get(ASK_NAME, 1)),
    ]
    name = F.coalesce(*(F.when(n != "", n) for n, _ in ways))
    return name, F.coalesce(*(F.when(n != "", F.lower(k)) for n, k in ways))


def intent(question: Column) -> Column:
    """A struct INTENT. Blank and null questions have the type unknown and confidence 0."""
    q, low = question, F.lower(question)
    name, keyword = _explicit(q)
    defined = F.contains(keyword, F.lit("define")) | F.contains(keyword, F.lit("definition"))
    explicit_kind = (
        F.when(F.contains(keyword, F.lit("struct")), "struct").when(defined, kind_of(name))
        .when(F.contains(keyword, F.lit("class")), "class").when(F.contains(keyword, F.lit("enum")), "enum").otherwise(kind_of(name))
    )
    function = F.coalesce(*(F.when(n != "", n) for n in (F.regexp_extract(q, "(?iU)" + p, 1) for p in (NAME_FUNCTION, FUNCTION_NAME))))
    conceptual, by_file, by_definition = has_any(low, CONCEPTUAL), has_any(low, FILE), has_any(low, DEFINITION)
    entity = F.try_element_at(entity_names(q), F.lit(1))
    kind = kind_of(entity)
    significant = F.filter(words(q), lambda w: (F.length(w) > 2) & ~F.array_contains(list_of(INSIGNIFICANT), F.lower(w)))
    bare = (F.size(significant) <= 2) & ~F.exists(significant, lambda w: F.array_contains(list_of(DEFINITION), F.lower(w)))
    enhanced = F.when(entity.isNotNull(), enhance(q, entity, kind)).otherwise(q)

    def made(type_: str, entity_type: Column, entity_name: Column, confidence: float, reason: Column, text: Column = q, is_file: bool = False) -> Column:
        return F.struct(F.lit(type_).alias("type"), entity_type.alias("entity_type"), entity_name.alias("entity_name"), F.lit(confidence).alias("confidence"), text.alias("enhanced_query"), F.lit(is_file).alias("is_file_search"), reason.alias("reasoning")).cast(INTENT)

    none = F.lit(None).cast("string")
    why = lambda reason, *parts: F.format_string(REASONS[reason], *parts) if parts else F.lit(REASONS[reason])
    return (
        F.when(q.isNull() | (F.trim(F.regexp_replace(q, r"(?U)\s+", " ")) == ""), made("unknown", none, none, 0.0, none))
        .when(name.isNotNull(), made("definition", explicit_kind, name, 0.95, why("explicit", explicit_kind, name)))
        .when(function.isNotNull(), made("definition", F.lit("function"), function, 0.9, why("function", function)))
        .when(entity.isNotNull() & ~conceptual & bare, made("definition", kind, entity, 0.85, why("bare", kind, entity)))
        .when(entity.isNotNull() & ~conceptual & (by_definition | by_file), made("hybrid", kind, entity, 0.75, why("hybrid", entity, F.when(by_file, "file").otherwise("definition")), enhanced))
        .when(conceptual, made("semantic", none, none, 0.9, why("conceptual")))
        .when(by_file, made("semantic", none, none, 0.8, why("file"), q, True))
        .otherwise(made("semantic", none, none, 0.5, why("default"), enhanced))
    )


def relationship_entity(question: Column) -> Column:
    """The entity of a question about relationships: the first capitalised word that starts with F, A, U, E or T,
    else the first capitalised word; null if there is none."""
    names = F.regexp_extract_all(question, F.lit(r"(?U)\b([A-Z][A-Za-z0-9_]+)\b"), F.lit(1))
    return F.coalesce(F.try_element_at(F.filter(names, lambda n: n.rlike("^[FAUET]")), F.lit(1)), F.try_element_at(names, F.lit(1)))


# What words of a question stand for.
SYNONYMS = {
    "vec": ["FVector", "vector"],
    "vector": ["FVector"],
    "rot": ["FRotator", "rotator"],
    "rotator": ["FRotator"],
    "quat": ["FQuat", "quaternion"],
    "transform": ["FTransform"],
    "string": ["FString", "FName", "FText"],
    "array": ["TArray"],
    "map": ["TMap"],
    "set": ["TSet"],
    "actor": ["AActor"],
    "pawn": ["APawn"],
    "char": ["ACharacter", "character"],
    "character": ["ACharacter"],
    "controller": ["AController", "APlayerController", "AAIController"],
    "hud": ["AHUD"],
    "mode": ["AGameMode", "AGameModeBase"],
    "state": ["AGameState", "AGameStateBase"],
    "instance": ["UGameInstance"],
    "comp": ["UActorComponent", "USceneComponent"],
    "mesh": ["UStaticMeshComponent", "USkeletalMeshComponent"],
    "capsule": ["UCapsuleComponent"],
    "movement": ["UCharacterMovementComponent", "UPawnMovementComponent"],
    "rhi": ["FRHICommandList", "FRHIResource", "FRHITexture"],
    "shader": ["FGlobalShader", "FShader"],
    "material": ["UMaterial", "UMaterialInstance", "FMaterialProxy"],
    "texture": ["UTexture", "UTexture2D", "FTextureResource"],
    "render": ["FRenderTarget", "UCanvas"],
    "bt": ["UBehaviorTree", "UBehaviorTreeComponent"],
    "behavior": ["UBehaviorTree", "UBlackboardComponent"],
    "blackboard": ["UBlackboardComponent", "UBlackboardData"],
    "nav": ["UNavigationSystemV1", "ANavigationData"],
    "perception": ["UAIPerceptionComponent", "UAISense"],
    "net": ["UNetDriver", "UNetConnection"],
    "rep": ["Replicated", "GetLifetimeReplicatedProps", "DOREPLIFETIME"],
    "rpc": ["Server", "Client", "NetMulticast"],
    "repl": ["DOREPLIFETIME", "DOREPLIFETIME_CONDITION"],
    "audio": ["UAudioComponent", "USoundCue", "USoundWave"],
    "sound": ["USoundBase", "FAudioDevice"],
    "anim": ["UAnimInstance", "UAnimSequence", "FAnimNode_Base"],
    "montage": ["UAnimMontage"],
    "skeleton": ["USkeleton", "FReferenceSkeleton"],
    "hit": ["FHitResult"],
    "trace": ["LineTraceSingle", "SphereTraceSingle", "CapsuleTraceSingle"],
    "overlap": ["OverlapResult", "FOverlapResult"],
    "collision": ["ECollisionChannel", "ECollisionResponse"],
    "constraint": ["FConstraintInstance", "UPhysicsConstraintComponent", "FConstraintSettings"],
    "constraints": ["FConstraintInstance", "UPhysicsConstraintComponent", "FConstraintSettings"],
    "physics": ["FBodyInstance", "UPhysicsAsset", "FConstraintInstance"],
    "physical": ["FConstraintInstance", "FPhysicalAnimationProfile", "UPhysicalAnimationComponent"],
    "contact": ["FHitResult", "FContactPoint"],
    "file": ["header", "source"],
    "location": ["path", "directory"],
    "log": ["UE_LOG"],
    "print": ["AddOnScreenDebugMessage"],
}


def synonym_map() -> Column:
    return lists_by(SYNONYMS)


def related(term: Column) -> Column:
    """What a word stands for; an empty array for others."""
    return F.coalesce(F.try_element_at(synonym_map(), F.lower(term)), F.array().cast("array<string>"))


def expand(question: Column) -> Column:
    """The question, what it and each of its words stand for, and the lower-case question with the word replaced by each
    of these, inside other words too. Distinct and sorted."""
    low = F.lower(question)
    of_words = F.transform(words(low), lambda w: F.flatten(F.transform(related(w), lambda s: F.array(F.replace(low, w, s), s))))
    return F.array_sort(F.array_distinct(F.concat(F.array(question), related(question), F.flatten(of_words))))


@cache
def _intent_of(column: str) -> Column:
    """Some hundred expressions, made once."""
    return intent(F.col(column))


def with_intent(questions: DataFrame, column: str = "question") -> DataFrame:
    return questions.withColumn("intent", _intent_of(column))


def with_terms(questions: DataFrame, column: str = "question") -> DataFrame:
    """``questions`` that have their intent, with expanded_terms, finds_entities (a term looks like an entity name, so that a semantic
    question also looks for definitions), semantic_text and entities (name and kind of all that definitions are looked up for)."""
    known = F.col("intent.type") != "unknown"
    out = questions.withColumn("expanded_terms", F.when(known, expand(F.col(column))).otherwise(F.array().cast("array<string>")))
    names = (F.col("intent.type") == "semantic") & F.exists("expanded_terms", lambda t: t.rlike(r"^[FUAIE]\p{Lu}."))
    text = F.when(F.size("expanded_terms") > 1, F.array_join("expanded_terms", " ")).otherwise(F.col("intent.enhanced_query"))
    terms = F.filter(F.transform("expanded_terms", lambda t: F.struct(t.alias("name"), kind_of(t).alias("kind"))), lambda t: (t["kind"] != "unknown") & ~t["name"].eqNullSafe(F.col("intent.entity_name")))
    own = F.when(F.col("intent.entity_name").isNotNull(), F.array(F.struct(F.col("intent.entity_name").alias("name"), F.col("intent.entity_type").alias("kind"))))
    none = F.array().cast("array<struct<name: string, kind: string>>")
    searched = F.when(F.col("intent.type").isin("definition", "hybrid") | names, F.concat(F.coalesce(own, none), terms))
    return out.withColumns({"finds_entities": names, "semantic_text": text, "entities": F.coalesce(searched, none)})


def analyse(questions: DataFrame, column: str = "question") -> DataFrame:
    """``questions`` with their intent and what ``with_terms`` adds."""
    return with_terms(with_intent(questions, column), column)
