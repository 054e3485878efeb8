"""Text for tests."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    """n words from a vocabulary that is large enough for shingles to be unique."""
    return " ".join(f"{rng.choice(WORDS)}{rng.randrange(vocabulary)}" for _ in range(n))
