"""Every rule compiles, can match, and any string it matches holds its keyword and a stem."""

import re
import re._constants as C
import re._parser as P

import pytest

from voxframe.llm.license_rules import STEMS, rules


def strings(parsed, cap=200):
    """Strings that a pattern matches, alternatives and optional parts both ways."""
    out = [""]
    for op, arg in parsed:
        if op is C.LITERAL:
            own = [chr(arg)]
        elif op is C.IN:
            kind, value = arg[0]
            own = [chr(value)] if kind is C.LITERAL else [chr(value[0])] if kind is C.RANGE else ["a"]
        elif op is C.ANY or op is C.CATEGORY:
            own = ["a"]
        elif op is C.SUBPATTERN:
            own = strings(arg[3])
        elif op is C.BRANCH:
            own = [s for branch in arg[1] for s in strings(branch)]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = arg
            own = [s * n for s in strings(body) for n in {low, max(low, 1)}]
        elif op is C.ASSERT:
            own = [""]
        else:
            raise NotImplementedError(op)
        out = [a + b for a in out for b in own][:cap]
    return out


@pytest.mark.parametrize("rule", rules(), ids=lambda r: f"{r['id']}-{r['label']}")
def test_gates_lose_nothing(rule):
    made = strings(P.parse(rule["pattern"]))
    assert made
    for s in made:
        line = s + " "
        assert re.search(rule["pattern"], line), line
        assert rule["keyword"] in line, line
        assert any(x in line for x in STEMS), line


def test_there_are_hundreds():
    assert len(rules()) > 200
    assert {r["priority"] for r in rules()} == {1, 2, 3, 4}
