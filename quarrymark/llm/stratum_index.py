"""One shard of a length-stratified index: building it from texts, searching it for many items.

Documents of equal length normaliser form a stratum; inside a shard they are numbered stratum by stratum.  The postings of a term
are grouped by (stratum, tf), the largest tf of a stratum first.  All documents of such a group have the same impact, which is
computed once; the first group of a stratum bounds what the term can add there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from quarrymark.llm.word_hashes import Words

BILLION, SCALE, SLOPE = 1_000_000_000, 1000, 12
VISIT = 256
MOST_DOCS = np.iinfo(np.int16).max
NO_ID = np.iinfo(np.int64).max


def normalisers(lengths: np.ndarray, documents: int, words: int) -> np.ndarray:
    return 100 - 25 + (25 * lengths.astype(np.int64) * documents) // max(words, 1)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (BILLION * tf) // (SCALE * tf + SLOPE * m)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start[i] .. start[i] + size[i] - 1 of all i, in a row."""
    size = size.astype(np.int64)
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def built(words: Words, ids: np.ndarray, documents: int, total: int) -> dict[str, np.ndarray] | None:
    """Arrays of one shard of at most MOST_DOCS texts; documents without words are left out."""
    lengths = np.diff(words.first)
    m = normalisers(lengths, documents, total)
    order = np.lexsort((ids, m))
    order = order[lengths[order] > 0]
    if not len(order):
        return None
    number = np.full(len(lengths), -1, dtype=np.int64)
    number[order] = np.arange(len(order))
    strata, first = np.unique(m[order], return_index=True)
    stratum = np.repeat(np.arange(len(strata)), np.diff(np.append(first, len(order))))
    text = np.repeat(np.arange(len(lengths)), lengths)
    terms, term = np.unique(words.hash, return_inverse=True)
    # (term, document) once, with the number of its occurrences
    key, tf = np.unique(term * len(order) + number[text], return_counts=True)
    term, doc = key // len(order), key % len(order)
    place = np.lexsort((doc, -tf, stratum[doc], term))
    term, doc, tf = term[place], doc[place], tf[place]
    change = np.ones(len(doc), dtype=bool)
    change[1:] = (np.diff(term) != 0) | (np.diff(tf) != 0) | (np.diff(stratum[doc]) != 0)
    group = np.flatnonzero(change)
    return {
        "docs": ids[order],
        "strata": strata,
        "stratum_docs": np.diff(np.append(first, len(order))).astype(np.int16),
        "terms": terms.view(np.int64),
        "term_docs": np.bincount(term, minlength=len(terms)).astype(np.int16),
        "term_groups": np.bincount(term[group], minlength=len(terms)).astype(np.int16),
        "group_tf": tf[group].astype(np.int32),
        "group_docs": np.diff(np.append(group, len(doc))).astype(np.int16),
        "postings": doc.astype(np.int16),
    }


@dataclass
class Items:
    """A block of items: of each its terms, and how often times how heavy they are."""

    first: np.ndarray
    term: np.ndarray
    weight: np.ndarray


class Best:
    """The best documents of every item so far: score down, document up."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.score = np.zeros((items, k), dtype=np.int64)
        self.doc = np.full((items, k), NO_ID)

    def offer(self, item: int, score: np.ndarray, doc: np.ndarray) -> None:
        scores, docs = np.concatenate((self.score[item], score)), np.concatenate((self.doc[item], doc))
        keep = np.lexsort((docs, -scores))[: self.k]
        self.score[item], self.doc[item] = scores[keep], docs[keep]


class Shard:
    def __init__(self, parts: dict[str, np.ndarray]) -> None:
        self.docs, self.postings = parts["docs"], parts["postings"]
        self.terms = parts["terms"].view(np.uint64)
        self.stratum_docs = parts["stratum_docs"]
        self.size = parts["group_docs"]
        self.start = np.cumsum(self.size, dtype=np.int64) - self.size
        # documents are numbered by stratum, so that any posting of a group tells the group's stratum
        stratum = np.repeat(np.arange(len(self.stratum_docs), dtype=np.int32), self.stratum_docs)
        self.stratum = stratum[self.postings[self.start]]
        self.groups = np.append(0, np.cumsum(parts["term_groups"], dtype=np.int64))
        self.impact = impacts(parts["group_tf"], parts["strata"][self.stratum])
        head = np.ones(len(self.stratum), dtype=bool)
        head[1:] = np.diff(self.stratum) != 0
        head[self.groups[:-1]] = True
        self.head = head

    def search(self, items: Items, best: Best) -> None:
        at = np.minimum(np.searchsorted(self.terms, items.term), len(self.terms) - 1)
        known = self.terms[at] == items.term
        score = np.zeros(len(self.docs), dtype=np.int64)
        for item in range(len(items.first) - 1):
            mine = np.flatnonzero(known[items.first[item] : items.first[item + 1]]) + items.first[item]
            if len(mine):
                self._one(at[mine], items.weight[mine], item, score, best)

    def _one(self, term: np.ndarray, weight: np.ndarray, item: int, score: np.ndarray, best: Best) -> None:
        sizes = self.groups[term + 1] - self.groups[term]
        groups = ranges(self.groups[term], sizes)
        gain = self.impact[groups] * np.repeat(weight, sizes)
        stratum = self.stratum[groups]
        head = self.head[groups]
        bound = np.zeros(len(self.stratum_docs), dtype=np.int64)
        np.add.at(bound, stratum[head], gain[head])
        visits = np.argsort(-bound, kind="stable")
        visits = visits[bound[visits] > 0]
        done = 0
        while done < len(visits):
            least = best.score[item, -1]
            # strata in order of their bounds; one that cannot reach the last place ends the search
            open_ = done + int(np.searchsorted(-bound[visits[done:]], -least, side="right"))
            upto = done + 1 + int(np.searchsorted(np.cumsum(self.stratum_docs[visits[done:open_]]), VISIT))
            now = visits[done : min(upto, open_)]
            if not len(now):
                return
            chosen = np.zeros(len(bound), dtype=bool)
            chosen[now] = True
            inside = chosen[stratum]
            which = groups[inside]
            docs = self.postings[ranges(self.start[which], self.size[which])]
            np.add.at(score, docs, np.repeat(gain[inside], self.size[which]))
            docs = np.unique(docs)
            reached = score[docs]
            good = (reached >= max(best.score[item, -1], 1)) if len(docs) else np.zeros(0, bool)
            best.offer(item, reached[good], self.docs[docs[good]])
            score[docs] = 0
            done += len(now)
