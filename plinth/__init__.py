"""plinth: a PySpark-native analytics engine (see README.md)."""

__all__ = ["Session"]
__version__ = "0.1.0"


def __getattr__(name):
    if name == "Session":
        from plinth.session import Session

        return Session
    raise AttributeError(name)
