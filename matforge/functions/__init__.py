"""Column expressions (JVM-side, inside whole-stage codegen)."""

from matforge.functions.cleaning import *  # noqa: F401,F403
