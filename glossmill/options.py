"""Tunables of the engine, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    excluded_pos: tuple[str, ...] = ()
    min_context_freq: int = 3
    context_threshold: float = 0.8
    num_first_meanings: int = 1
    sim_threshold: float = 0.6
    damping_meanings: float = 0.6
    damping_variables: float = 0.2
    num_subgraphs: int = 1000
    extraction_lambda: float = 1.0
    tree_edit_lambda: float = 0.1
    softmax_temperature: float = 0.01
    max_tries: int = 1000
    max_span: int = 3
    #: Nodes of an unfolded tree for each of its vertices from which on repeats stand as leaves; None: never.
    tree_repeats: int | None = 4
    #: True: the bias follows the visited item; False: as first written, a mere scalar.
    personalised: bool = True
