"""What a model is asked, and the shape of its replies."""

from __future__ import annotations

from loomgraph.schemas import IDEA_RELATIONS, IDEA_TYPES, PAPER_RELATIONS

_TEXT = {"type": "string"}


def _list(of: dict) -> dict:
    return {"type": "array", "items": of}


def _object(title: str, **properties: dict) -> dict:
    return {"title": title, "type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}


_IDEA = _object("idea", statement=_TEXT, type={"enum": list(IDEA_TYPES)}, relation_to_paper={"enum": list(PAPER_RELATIONS)}, domain=_TEXT, entities=_list(_TEXT))
_IDEA_RULES = (
    "An idea is one full sentence that a reader from another field understands without the text: no pronouns, no mention of the authors. "
    f"Give its type ({', '.join(IDEA_TYPES)}), how the text stands to it ({', '.join(PAPER_RELATIONS)}), a short field name in lower case, and up to five named things."
)

#: name: (instruction, reply's schema or None for plain text)
TASKS: dict[str, tuple[str, dict | None]] = {
    "extract": (f"Read the abstract and name the one to four claims worth citing it for. {_IDEA_RULES} Also state its main result in one sentence.", _object("extract", key_finding=_TEXT, ideas=_list(_IDEA))),
    "condense": (f"Condense this part of a document into a summary of some three sentences, its main result, and up to three ideas at the part's own level of detail. {_IDEA_RULES}", _object("condense", summary=_TEXT, key_finding=_TEXT, ideas=_list(_IDEA))),
    "adjudicate": (
        "A graph of ideas gets a new one. You see the nearest known ideas with their similarity. Answer merge only for a candidate marked merge-eligible that makes the same claim; "
        f"link, with one of {', '.join(IDEA_RELATIONS)}, if it bears on a candidate (part_of where one is the narrower); else new. Levels: 0 is specific, higher is broader.",
        _object("adjudicate", decision={"enum": ["merge", "link", "new"]}, target={"type": ["string", "null"]}, relation={"type": ["string", "null"]}, note=_TEXT),
    ),
    "reflect": ("Judge whether the notes answer the topic. In depth mode look for missing steps of the explanation, in breadth mode for fields not visited. Propose up to three literature queries; done is true only if more reading would add little.", _object("reflect", assessment=_TEXT, gaps=_list(_TEXT), queries=_list(_TEXT), done={"type": "boolean"})),
    "questions": ("Name the separate questions that the topic asks, in its order and words, five at most. One clause is one question; don't narrow one by another.", _object("questions", questions=_list(_TEXT))),
    "section": ("Write the body of a report section that answers the question from the notes. Cite each claim as [PMID n] with numbers from the notes only. Say so briefly if the notes don't answer it. End with what is contradictory or missing.", None),
    "summary": ("Write the summary of a report from its sections, citations kept. Then, under the heading `## Open questions`, list what remains open.", None),
}
