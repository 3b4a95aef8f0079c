"""Prompts for tables of rows: a template per kind and language, filled by expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How much of a text a prompt of each kind shows.
CAPS = {
    "summary": {"content": 4000}, "section_summary": {"content": 4000}, "evaluate": {"content": 12_000}, "evaluate_json": {"content": 12_000}, "answer": {"content": 8000}, "answer_history": {"content": 8000},
    "synthesise": {"content": 3000}, "rewrite": {"content": 200}, "entities": {"content": 12_000},
}
SYSTEM = {
    "select": {"en": "You find your way through a tree of notes.", "ko": "노트 트리를 탐색합니다."},
    "evaluate": {"en": "You judge whether a note answers a question.", "ko": "노트가 질문에 답하는지 판단합니다."},
    "answer": {"en": "You answer from the notes given and from nothing else.", "ko": "주어진 노트만으로 답합니다."},
}
TEMPLATES = {
    "summary": {"en": "Sum up this note in one sentence.\n\nTitle: {title}\n\n{content}", "ko": "이 노트를 한 문장으로 요약하세요.\n\n제목: {title}\n\n{content}"},
    "section_summary": {"en": "Sum up this section in one sentence.\n\nNote: {note}\nSection: {title}\n\n{content}", "ko": "이 섹션을 한 문장으로 요약하세요.\n\n노트: {note}\n섹션: {title}\n\n{content}"},
    "select": {
        "en": "Question: {query}\n\nSo far: {path}\n\n{candidates}\n\nReply SELECT: <node_id> or DONE: <reason>.",
        "ko": "질문: {query}\n\n지금까지: {path}\n\n{candidates}\n\nSELECT: <node_id> 또는 DONE: <이유>로 답하세요.",
    },
    "evaluate": {
        "en": "Question: {query}\n\nNote: {title}\n\n{content}\n\nReply SUFFICIENT: <reason> or INSUFFICIENT: <what is missing>.",
        "ko": "질문: {query}\n\n노트: {title}\n\n{content}\n\nSUFFICIENT: <이유> 또는 INSUFFICIENT: <부족한 것>으로 답하세요.",
    },
    "select_json": {
        "en": "Question: {query}\n\nSo far: {path}\n\n{candidates}\n\nReply with one JSON object and nothing else, its keys action (SELECT or DONE), node_id and reason.",
        "ko": "질문: {query}\n\n지금까지: {path}\n\n{candidates}\n\naction(SELECT 또는 DONE), node_id, reason 키를 가진 JSON 객체 하나로만 답하세요.",
    },
    "evaluate_json": {
        "en": "Question: {query}\n\nNote: {title}\n\n{content}\n\nReply with one JSON object and nothing else, its keys sufficient (true or false) and reason.",
        "ko": "질문: {query}\n\n노트: {title}\n\n{content}\n\nsufficient(true 또는 false), reason 키를 가진 JSON 객체 하나로만 답하세요.",
    },
    "answer": {"en": "Question: {query}\n\n{notes}\n\nAnswer, and name the notes used as [[title]].", "ko": "질문: {query}\n\n{notes}\n\n답하고 쓴 노트를 [[제목]]으로 밝히세요."},
    "answer_history": {
        "en": "Before:\n{history}\n\nQuestion: {query}\n\n{notes}\n\nAnswer, and name the notes used as [[title]].",
        "ko": "이전 대화:\n{history}\n\n질문: {query}\n\n{notes}\n\n답하고 쓴 노트를 [[제목]]으로 밝히세요.",
    },
    "decompose": {"en": "Split into at most {n} questions, a line SUB: <question> each, or reply SINGLE.\n\n{query}", "ko": "최대 {n}개의 질문으로 나누어 SUB: <질문> 줄로 쓰거나 SINGLE로 답하세요.\n\n{query}"},
    "synthesise": {"en": "Question: {query}\n\n{parts}\n\nMake one answer of these.", "ko": "질문: {query}\n\n{parts}\n\n하나의 답으로 종합하세요."},
    "rewrite": {"en": "{history}\n\nRewrite so that it stands alone: {query}", "ko": "{history}\n\n독립된 질문으로 다시 쓰세요: {query}"},
    "entities": {
        "en": "List the entities of this note, a line ENTITY: name | category | description each, or NONE.\n\nTitle: {title}\n\n{content}",
        "ko": "이 노트의 엔티티를 ENTITY: 이름 | 분류 | 설명 줄로 쓰거나 NONE으로 답하세요.\n\n제목: {title}\n\n{content}",
    },
    "page": {"en": "Write a page on {name} ({category}).\n\n{mentions}\n\nOthers: {xrefs}", "ko": "{name} ({category})에 대한 페이지를 쓰세요.\n\n{mentions}\n\n다른 엔티티: {xrefs}"},
}


def parts_of(kind: str, lang: str = "en", with_system: bool = False) -> list[tuple[str, str | None]]:
    """The template as (text, name of the field that follows)."""
    head = SYSTEM.get(kind, {}).get(lang, "") + "\n\n" if with_system and kind in SYSTEM else ""
    return [(text, name) for text, name, _, _ in string.Formatter().parse(head + TEMPLATES[kind][lang])]


def build_prompt(kind: str, fields: dict[str, Column], lang: str = "en", with_system: bool = False) -> Column:
    """The prompt of a row; a null field is empty, long contents are cut to what the kind shows."""
    out: list[Column] = []
    for text, name in parts_of(kind, lang, with_system):
        out.append(F.lit(text))
        if name:
            value = F.coalesce(fields[name].cast("string"), F.lit(""))
            out.append(F.substring(value, 1, CAPS[kind][name]) if name in CAPS.get(kind, {}) else value)
    return F.concat(*out)


def retry_prompt(prompt: Column, error: Column) -> Column:
    return F.concat(prompt, F.lit("\n\nThe last reply could not be read ("), error, F.lit("). Use the format asked for and nothing else."))


def listed_notes(notes: DataFrame, kind: str = "answer") -> DataFrame:
    """(query_id, notes): the gathered notes (query_id, position, title, content) of a query as one text, each cut, in order."""
    cap = CAPS[kind]["content"]
    entry = F.struct("position", F.concat(F.lit("--- "), "title", F.lit(" ---\n"), F.substring("content", 1, cap)).alias("text"))
    return notes.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["text"]), "\n\n").alias("notes"))
