"""The same operators over arriving files; every result equals its batch counterpart."""
