"""Prompts for the model-dependent steps, as columns, in English and Chinese."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: {name} stands for a column. What is to be done comes first, then a blank line, then the text; a number after a colon would cut a column to so many characters.
TEMPLATES = {
    "fake_queries": {
        "en": "Read the conversation below and write {n} questions that it answers, as a JSON list of strings.\n\n{session}",
        "zh": "阅读下面的对话，写出它能回答的{n}个问题，用JSON字符串列表表示。\n\n{session}",
    },
    "knowledge": {
        "en": "List the facts in the conversation below as JSON objects with the keys time, subject, fact and entities_or_values.\nKnown before: {context}\n\n{session}",
        "zh": "把下面对话中的事实列为JSON对象，键为time、subject、fact、entities_or_values。\n已知：{context}\n\n{session}",
    },
    "decompose": {
        "en": "Split this question into one to four simpler ones, as a JSON list of objects with query and keywords.\nSaid before: {history}\n\n{query}",
        "zh": "把这个问题拆成一到四个更简单的问题，用含query和keywords的JSON对象列表表示。\n之前的对话：{history}\n\n{query}",
    },
    "answer": {
        "en": "Answer the question from these memories only.\n\n{context}\n\nQuestion: {query}",
        "zh": "只根据这些记忆回答问题。\n\n{context}\n\n问题：{query}",
    },
    "propositions": {
        "en": "Write the statements that the conversation below makes, each complete by itself, as a JSON list of strings.\n\n{session}",
        "zh": "把下面对话中的陈述写成各自完整的句子，用JSON字符串列表表示。\n\n{session}",
    },
    "reflections": {
        "en": "Write what can be concluded from the conversation below about its speakers, as a JSON list of strings.\n\n{session}",
        "zh": "写出从下面对话中可以得出的关于说话人的结论，用JSON字符串列表表示。\n\n{session}",
    },
    "paraphrases": {
        "en": "Ask for the same answer in five indirect ways (implication, scenario, consequence, periphery, negation), as a JSON list of five strings.\n\nQuestion: {query}\nAnswer: {answer}\nContext: {context}",
        "zh": "用五种间接方式（暗示、情景、后果、旁及、否定）提出同一问题，用五个字符串的JSON列表表示。\n\n问题：{query}\n答案：{answer}\n上下文：{context}",
    },
    "notes": {
        "en": "Take notes on the conversation below, as JSON objects with title, key_insight, content and tags.\n\n{session}",
        "zh": "为下面的对话做笔记，用含title、key_insight、content、tags的JSON对象表示。\n\n{session}",
    },
}


def prompt(name: str, language: str = "en", **values: Column | str | int) -> Column:
    """The filled-in template; a null value is left empty. An unknown language is taken for English."""
    import re

    text = TEMPLATES[name].get(language, TEMPLATES[name]["en"])
    parts, at = [], 0
    for m in re.finditer(r"\{(\w+)(?::(\d+))?\}", text):
        value = values.get(m.group(1), "")
        column = value if isinstance(value, Column) else F.lit(value)
        column = F.coalesce(column.cast("string"), F.lit(""))
        parts += [F.lit(text[at : m.start()]), F.substring(column, 1, int(m.group(2))) if m.group(2) else column]
        at = m.end()
    return F.concat(*parts, F.lit(text[at:]))
