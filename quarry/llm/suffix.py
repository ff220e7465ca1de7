"""Suffix orders of many short sequences at once, by prefix doubling over arrays."""

from __future__ import annotations

import numpy as np

from .text import _P, gather, range_hash, unequal

SYMBOLS_AT_ONCE = 6  # symbols below 2**10 that one 64-bit key holds


def suffix_order(code: np.ndarray, end: np.ndarray, group: np.ndarray | None = None, at_once: int = 1) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, ranks by the first 1, 2, 4, ... symbols) of the suffixes code[i:end[i]].

    A suffix that is a prefix of another comes first; suffixes equal to their ends have one rank.
    group: suffixes of different groups are kept apart, in the groups' order. at_once: symbols, small
    numbers then, that the first round takes together; only the final ranks are given then.
    """
    n = len(code)
    if not n:
        return np.zeros(0, np.int64), []
    if at_once > 1:
        key, room = np.zeros(n, np.int64), end - np.arange(n)
        wide = np.concatenate([code.astype(np.int64) + 1, np.zeros(at_once, np.int64)])
        for k in range(at_once):
            key = key << 10 | np.where(room > k, wide[k : n + k], 0)
    else:
        _, key = np.unique(code, return_inverse=True)
        key = key.astype(np.int64)
    if group is not None:
        key += group.astype(np.int64) * n
    order = np.argsort(key)
    head = _heads(key[order])
    rank = np.empty(n, np.int64)
    rank[order] = head
    ranks, span = [rank.copy()], at_once
    active = np.flatnonzero(_tied(head) & (order + span <= end[order]))  # places in the order whose suffixes still tie with others
    while len(active):
        at = order[active]
        after = at + span
        second = np.where(after < end[at], rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + second
        by = np.argsort(key)
        order[active], key, second = at[by], key[by], second[by]
        head = active[_heads(key)]
        rank[order[active]] = head
        if at_once == 1:
            ranks.append(rank.copy())
        active = active[_tied(head) & (second > 0)]  # suffixes that end together are equal
        span *= 2
    if at_once > 1:
        ranks = [rank]
    return order, ranks


def _heads(key: np.ndarray) -> np.ndarray:
    """The place at which each sorted key's run begins."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))


def _tied(head: np.ndarray) -> np.ndarray:
    tie = np.zeros(len(head), bool)
    same = head[1:] == head[:-1]
    tie[1:] |= same
    tie[:-1] |= same
    return tie


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray], end: np.ndarray) -> np.ndarray:
    """lcp[i]: symbols that the suffixes order[i - 1] and order[i] share at their beginning; lcp[0] = lcp[n] = 0."""
    out = np.zeros(len(order) + 1, np.int64)
    if len(order) < 2:
        return out
    pair = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]]) + 1
    a, b = order[pair - 1].copy(), order[pair].copy()
    end_a, end_b = end[a], end[b]
    size = np.zeros(len(pair), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        step = 1 << level
        ok = (a + step <= end_a) & (b + step <= end_b)
        ok[ok] = ranks[level][a[ok]] == ranks[level][b[ok]]
        size[ok] += step
        a[ok] += step
        b[ok] += step
    out[pair] = size
    return out


def prefix_free_order(symbols: np.ndarray, end: np.ndarray, trigger: np.ndarray, overlap: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """The order of all suffixes symbols[i:end[i]], or of those at wanted places, by prefix-free parsing.

    symbols: several texts one after another; end: where each place's text ends; trigger: places at
    which a gram of `overlap` symbols ends a phrase and begins the next. Phrases overlap by that
    gram, so no phrase's suffix of more than `overlap` symbols is a prefix of another's. The suffix
    array of the distinct phrases and the suffix array of the parse (the texts as sequences of phrase
    ranks) combine: a text's suffix compares by its phrase's suffix, then by the parse that follows.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    place = np.arange(n) if wanted is None else np.flatnonzero(wanted)
    first = np.zeros(n, bool)
    first[0] = True
    first[1:] = end[1:] != end[:-1]
    starts = np.flatnonzero(first | (trigger & (np.arange(n) + overlap <= end)))
    text_end = end[starts]
    follows = np.zeros(len(starts), bool)  # the next phrase is of the same text
    follows[:-1] = text_end[1:] == text_end[:-1]
    stop = text_end.copy()
    stop[:-1][follows[:-1]] = starts[1:][follows[:-1]] + overlap
    # dictionary: distinct phrases, found by hash, told apart by their bytes; a phrase that ends a text differs from one that goes on
    size = stop - starts
    h = range_hash(symbols, starts, stop, _P) << np.uint64(1) | ~follows
    _, sample, phrase = np.unique(h, return_index=True, return_inverse=True)
    if unequal(symbols, starts, size, symbols, starts[sample][phrase], size[sample][phrase]).any():
        held: dict[tuple[bytes, bool], int] = {}
        phrase = np.array([held.setdefault((symbols[a:b].tobytes(), f), len(held)) for a, b, f in zip(starts.tolist(), stop.tolist(), follows.tolist(), strict=True)])
        _, sample = np.unique(phrase, return_index=True)
    length = (stop - starts)[sample] + ~follows[sample]  # with a closing symbol below all others
    begin = np.cumsum(length) - length
    words = gather(symbols.astype(np.int64) + 1, starts[sample], (stop - starts)[sample])
    dictionary = np.zeros(int(length.sum()), np.int64)
    keep = np.ones(len(dictionary), bool)
    keep[(begin + length - 1)[~follows[sample]]] = False
    dictionary[keep] = words
    _, ranks = suffix_order(dictionary, np.repeat(begin + length, length), at_once=SYMBOLS_AT_ONCE)
    of_phrase = ranks[-1]
    # parse: each text as its phrases' ranks
    parse = of_phrase[begin][phrase]
    last = np.flatnonzero(~follows)
    parse_end = last[np.searchsorted(last, np.arange(len(starts)))] + 1
    parse_order, parse_ranks = suffix_order(parse, parse_end)
    rank = parse_ranks[-1]
    # each place belongs to the phrase in which more than `overlap` symbols follow, or its text ends
    own = np.searchsorted(starts, place, "right") - 1
    first_key = of_phrase[begin[phrase[own]] + place - starts[own]]
    next_key = np.where(follows[own], rank[np.minimum(own + 1, len(rank) - 1)] + 1, 0)
    return place[np.argsort(first_key * (len(starts) + 2) + next_key)]
