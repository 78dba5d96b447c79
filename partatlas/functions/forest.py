"""Connected labels of one batch of edges."""

import numpy as np


def smallest_labels(left, right, n):
    """Smallest node reachable from each of the nodes 0..n-1 over the given edges."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if np.array_equal(label, before):
            return label


def spanning_edges(src, dst):
    """Edges (node, smallest node of its component) that connect the same nodes."""
    nodes, dense = np.unique(np.concatenate([src, dst]), return_inverse=True)
    label = smallest_labels(dense[: len(src)], dense[len(src) :], len(nodes))
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def maximum_forest(src, dst, weight):
    """Positions of the edges of a maximum spanning forest; of equal weights, lower (src, dst) come first.

    Borůvka's rounds: every component takes its first edge in that order, components that an
    edge connects become one, and edges inside a component are left out.
    """
    nodes, dense = np.unique(np.concatenate([src, dst]), return_inverse=True)
    left, right = dense[: len(src)], dense[len(src) :]
    order = np.lexsort((np.maximum(src, dst), np.minimum(src, dst), -weight))
    left, right = left[order], right[order]
    taken, open_, label = [], np.arange(len(order)), np.arange(len(nodes))
    while True:
        open_ = open_[label[left[open_]] != label[right[open_]]]
        if not len(open_):
            return np.sort(order[np.concatenate(taken)]) if taken else np.zeros(0, dtype=np.int64)
        first = np.full(len(nodes), len(order))
        np.minimum.at(first, label[left[open_]], open_)
        np.minimum.at(first, label[right[open_]], open_)
        chosen = np.unique(first[first < len(order)])
        taken.append(chosen)
        joined = smallest_labels(label[left[chosen]], label[right[chosen]], len(nodes))
        label = joined[label]
