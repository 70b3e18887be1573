"""Answer in passes: plan, drafts, a vote if there are several, critique, revision."""

from __future__ import annotations

import re

from .protocol import ChatModel

CHECKLIST = ["Answers the question asked.", "Says nothing the context does not support.", "Gives concrete steps or code.", "Handles edge cases.", "Is brief."]
PREAMBLE = "You are a careful and exact coding assistant."


def chosen_draft(vote: str, drafts: list[str]) -> str:
    """The draft whose number (from 1) is the vote's first digit; the first draft if that names none."""
    digit = re.search(r"\d", vote)
    n = int(digit[0]) - 1 if digit else 0
    return drafts[n] if 0 <= n < len(drafts) else drafts[0]


def iterative_answer(client: ChatModel, model: str, question: str, context: list[str], max_tokens: int = 600, beams: int = 1, checklist: list[str] = CHECKLIST, stream_final: bool = True, on_final_chunk=None, preamble: str = PREAMBLE, draft_temperature: float = 0.7, refine_temperature: float = 0.3) -> str:
    given = "\n\n".join(context) or "(no extra context)"
    base = f"Question:\n{question}\n\nContext:\n{given}\n\n"

    def ask(task: str, tokens: int, temperature: float, stream: bool = False, on_chunk=None) -> str:
        messages = [{"role": "system", "content": preamble}, {"role": "user", "content": base + task}]
        return client.chat(model, messages, stream=stream, on_chunk=on_chunk, options={"num_predict": tokens, "temperature": temperature}).strip()

    plan = ask("Write a plan of at most six numbered steps. Do not answer yet.", 256, 0.2)
    drafts = [ask(f"Plan:\n{plan}\n\nFollow it and write a draft answer of at most {max_tokens} tokens. Say what the context lacks.", max_tokens, draft_temperature) for _ in range(max(1, beams))]
    best = drafts[0]
    if len(drafts) > 1:
        shown = "\n\n".join(f"Draft {i}:\n{d}" for i, d in enumerate(drafts, 1))
        best = chosen_draft(ask(f"{shown}\n\nWhich draft is most relevant, faithful, clear and correct? Reply with its number only.", 16, 0.0), drafts)
    points = "\n".join(f"- {c}" for c in checklist)
    critique = ask(f"Draft:\n{best}\n\nChecklist:\n{points}\n\nList what must be fixed, or say 'Looks good.'", 256, 0.2)
    return ask(f"Draft:\n{best}\n\nCritique:\n{critique}\n\nWrite the final answer only.", max_tokens, refine_temperature, stream_final, on_final_chunk)
