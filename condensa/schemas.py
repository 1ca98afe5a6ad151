"""Schemas of the tables that the library reads and writes; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


RULES = _struct(
    id=I, original=S, compressed=S, pattern_type=S, priority=I, language=S, domain=S, frequency=I, success_rate=D, version=I, is_active=B, last_used=T.TimestampType(), created_at=T.TimestampType(), updated_at=T.TimestampType(), metadata=S
)
METRICS = _struct(
    session_id=S, timestamp=D, original_length=I, compressed_length=I, original_tokens=I, compressed_tokens=I, compression_ratio=D, quality_score=D, processing_time_ms=I, engine_used=S, domain=S, level=S, pattern_matches_count=I, success=B
)
SESSIONS = _struct(session_id=S, created_at=T.TimestampType(), original_text=S, compressed_text=S, level=S, domain=S, engine_used=S, compression_ratio=D, quality_score=D)
FEEDBACK = _struct(session_id=S, rating=I, comment=S, created_at=T.TimestampType())
USAGE = _struct(pattern_id=I, session_id=S, position=I, success=B, used_at=T.TimestampType())
CONFLICTS = _struct(first_id=I, second_id=I, kind=S, severity=S)
VERSIONS = _struct(pattern_id=I, version=I, original=S, compressed=S, priority=I, changed_at=T.TimestampType())
MATCH = _struct(pattern_id=I, position=I, original_text=S, compressed_text=S, priority=I, confidence=D)
PROMPTS = T.StructType(
    [T.StructField("prompt", S), T.StructField("sessionId", S), T.StructField("files", T.ArrayType(S)), T.StructField("context", _struct(command=S, projectType=S, language=S, framework=S)), T.StructField("metadata", T.MapType(S, S))]
)
LEVELS = ("none", "light", "balanced", "aggressive")
PATTERN_TYPES = ("phrase", "compound", "word", "abbreviation", "structure")
