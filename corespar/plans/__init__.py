"""See the README for what lives here."""

from corespar.plans import problems, retrieval  # noqa: E402, F401
