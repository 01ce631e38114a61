"""What a client puts into a conversation, turn by turn: when, and which memories.

The first turn with a question gets memories whatever it says; later ones do under the
policy ``always``, never under ``once``, and under ``smart`` if they hold a keyword and
are long enough. Memories already in the session (the last hundred), below the
threshold, or said by the assistant in the last ten messages are left out; how many are
taken shrinks with what the session was given. A block of memories that a session has
had word for word is not given again.

``decisions`` folds a table of turns, ``decision_stream`` a stream of them
(``transformWithState``: one value and one map of digests a session); both use
``Session``. Input: session, turn, role, text and the candidates of the turn as arrays
ids, contents, similarities, best first. A task holds one session's hundred ids and ten
messages, not its turns, so a session may be as long as it likes.

Defined cases: null role or text is empty; empty user turns ask nothing. Turns of one
number are ordered by role and text. Null candidates are none.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Words that ask for memories.
KEYWORDS = [
    "记得", "之前", "上次", "以前", "回忆", "记忆", "项目", "代码", "架构", "设计", "配置", "实现", "功能", "技术", "框架", "模块", "组件", "接口", "服务", "文件",
    "怎么", "如何", "在哪", "什么", "为什么", "是否", "有没有", "偏好", "喜欢", "习惯", "风格", "约束", "决策", "约定", "规范",
    "recall", "remember", "previous", "earlier", "project", "code", "config", "architecture", "design", "how", "where", "what", "why", "when",
]


class Policy(NamedTuple):
    strategy: str = "smart"  # or once, always
    first: int = 5
    later: int = 3
    shortest: int = 5
    threshold: float = 0.5
    most_ids: int = 100
    look_back: int = 10
    snippet: int = 100
    shrinking: bool = True


def keyword_of(text: str) -> str | None:
    low = text.lower()
    return next((k for k in KEYWORDS if k in low), None)


def shrunk(most: int, n_given: int) -> int:
    """At least two; a twentieth less for each memory given, half at most."""
    return max(2, math.floor(most * (1 - min(0.5, n_given * 0.05))))


OUTPUT = "session long, turn long, action string, keyword string, n_known int, n_low int, n_said int, injected array<string>"


@dataclass
class Session:
    """What a session has been given and what was said in it last."""

    policy: Policy
    begun: bool = False
    ids: list[str] = field(default_factory=list)  # oldest first
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)

    def turn(self, role: str, text: str, candidates: list[tuple[str, str, float]], digests) -> tuple | None:
        """The decision on a turn (action, keyword, n_known, n_low, n_said, injected), or nothing for one that asks nothing. ``digests``: those of blocks given before."""
        out = self._decided(text, candidates, digests) if role == "user" and text else None
        if role in ("user", "assistant"):
            self.roles, self.texts = [*self.roles, role][-self.policy.look_back :], [*self.texts, text][-self.policy.look_back :]
        return out

    def _decided(self, text: str, candidates: list, digests) -> tuple:
        p, word = self.policy, None
        if not self.begun:
            action = "first"
        elif len(text) < p.shortest:
            return "short", None, 0, 0, 0, []
        elif p.strategy == "always":
            action = "always"
        else:
            word = keyword_of(text) if p.strategy == "smart" else None
            action = "keyword" if word else "none"
        if action == "none":
            return action, None, 0, 0, 0, []
        known = set(self.ids)
        new = [c for c in candidates if c[0] not in known]
        near = [c for c in new if c[2] >= p.threshold]
        said = "\n".join(t for r, t in zip(self.roles, self.texts) if r == "assistant")
        fresh = [c for c in near if c[1][: p.snippet] not in said] if self.roles else near
        most = p.later if self.begun else p.first
        given = fresh[: shrunk(most, len(self.ids)) if p.shrinking else most]
        counts = (len(candidates) - len(new), len(new) - len(near), len(near) - len(fresh))
        if not given:
            return "empty", word, *counts, []
        digest = hashlib.sha1("\n".join(c[1] for c in given).encode()).hexdigest()
        if digest in digests:
            return "repeated", word, *counts, []
        digests.add(digest)
        for c in given:
            self.ids = [*(x for x in self.ids if x != c[0]), c[0]][-p.most_ids :]
        self.begun = True
        return action, word, *counts, [c[0] for c in given]


def _columns(turns: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return turns.where("session is not null").select(F.col("session").cast("long").alias("session"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"), F.col("ids").cast("array<string>").alias("ids"), F.col("contents").cast("array<string>").alias("contents"), F.col("similarities").cast("array<double>").alias("similarities"))


def _candidates(row) -> list[tuple[str, str, float]]:
    return [] if row.ids is None else [(i, c or "", s) for i, c, s in zip(row.ids, row.contents, row.similarities) if i is not None and s is not None]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["session", "turn", "action", "keyword", "n_known", "n_low", "n_said", "injected"]).astype({"n_known": "int32", "n_low": "int32", "n_said": "int32"})


def decisions(turns: DataFrame, policy: Policy = Policy()) -> DataFrame:
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, session, digests = None, None, set()
        for b in batches:
            rows = []
            for r in b.itertuples():
                if r.session != key:
                    key, session, digests = r.session, Session(policy), set()
                found = session.turn(r.role, r.text, _candidates(r), digests)
                if found:
                    rows.append((key, r.turn, *found))
            yield _frame(rows)

    return _columns(turns).repartition("session").sortWithinPartitions("session", "turn", "role", "text").mapInPandas(fold, OUTPUT)


class _Digests:
    """A session's digests in its map state."""

    def __init__(self, state):
        self.state = state

    def __contains__(self, digest: str) -> bool:
        return self.state.containsKey((digest,))

    def add(self, digest: str) -> None:
        self.state.updateValue((digest,), (True,))


class InjectionPolicy(StatefulProcessor):
    def __init__(self, policy: Policy = Policy()):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("session", "begun boolean, ids array<string>, roles array<string>, texts array<string>")
        self.digests = _Digests(handle.getMapState("digests", "digest string", "given boolean"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        session = Session(self.policy)
        if self.value.exists():
            begun, *lists = self.value.get()
            session = Session(self.policy, begun, *(list(x) for x in lists))
        out = []
        for r in pd.concat(list(rows)).sort_values(["turn", "role", "text"], na_position="first").itertuples():
            found = session.turn(r.role, r.text, _candidates(r), self.digests)
            if found:
                out.append((key[0], r.turn, *found))
        self.value.update((session.begun, session.ids, session.roles, session.texts))
        yield _frame(out)

    def close(self) -> None:
        pass


def decision_stream(turns: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The same decisions on a stream; a session's turns must come in order."""
    return _columns(turns).groupBy("session").transformWithStateInPandas(InjectionPolicy(policy), OUTPUT, "Append", "None")
