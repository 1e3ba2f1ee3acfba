"""Quality rules and line dedup in plain Python."""

from collections import Counter, defaultdict

from tapeflow.llm import quality_rules


def brute_rules(text, limits=quality_rules.Limits()):
    words = (text or "").encode().split()

    def cover(k):
        count = Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
        return len({j for i in range(len(words) - k + 1) if count[tuple(words[i : i + k])] > 1 for j in range(i, i + k)})

    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    repeat, covered = cover(5), cover(limits.min_repeat)
    failed = len(words) < 10 or 100 * repeat > 20 * len(words)
    long = cover(limits.max_repeat + 1) > 0
    chars = sum(len(w.decode()) for w in words)
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    kept = not failed and 100 * covered <= limits.max_covered_pct * len(words) and not long
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat, failed, kept, covered


def brute_lines(rows, min_docs=3):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    low = float("-inf")
    holders = defaultdict(set)
    for doc_id, text, *_ in rows:
        for x in (text or "").split("\n"):
            holders[key(x)].add(low if doc_id is None else doc_id)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= min_docs}
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if gone.get(key(x), low if doc_id is None else doc_id) == (low if doc_id is None else doc_id)]
        out.append((doc_id, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out
