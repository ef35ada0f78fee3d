"""Schemas of the tables. They are parsed when first asked for, as that needs a session."""

from __future__ import annotations

from pyspark.sql.types import StructType


def _s(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


_KP = "struct<time:string,subject:string,fact:string,entities_or_values:string>"
_LAZY = {
    "MEMORIES": "memory_id string, sample_id string, session_id string, session_text string, metadata map<string,string>, created_at string",
    "FAKE_QUERIES": "query_id string, memory_id string, pos int, text string, answer string, embedding array<float>, parent_ids array<string>, depth int",
    "CONTENT_CHUNKS": "memory_id string, chunk_index int, embedding array<float>",
    "PARAGRAPHS": "memory_id string, paragraph_index int, text string, embedding array<float>",
    "KNOWLEDGE_POINTS": "memory_id string, kp_index int, time string, subject string, fact string, entities_or_values string, embedding array<float>",
    "VECTORS": "method string, session_id string, pos int, text string, embedding array<float>",
    "PARAPHRASES": "query_id string, style string, text string, embedding array<float>",
    "TRUE_QUERIES": "query_id string, text string, embedding array<float>",
    "MEMORY_DOCUMENT": f"memory_id string, session_text string, content_embeddings array<array<double>>, fake_queries array<struct<query_id:string,memory_id:string,text:string,answer:string,embedding:array<double>,parent_ids:array<string>,depth:int>>, knowledge_points array<{_KP}>, paragraphs array<string>, paragraph_embeddings array<array<double>>, metadata map<string,string>, created_at string",
    "SAMPLE_DOCUMENT": "sample_id string, conversation map<string,string>, qa array<struct<question:string,answer:string,category:int,evidence:array<string>>>",
    "HAYSTACK_DOCUMENT": "question_id string, question string, answer string, question_type string, question_date string, answer_session_ids array<string>, haystack_session_ids array<string>, haystack_sessions array<array<struct<role:string,content:string>>>, haystack_dates array<string>",
}


def __getattr__(name: str) -> StructType:
    if name in _LAZY:
        return _s(_LAZY[name])
    raise AttributeError(name)
