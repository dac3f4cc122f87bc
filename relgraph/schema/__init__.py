"""Schemas: definitions of types with relations and permissions, built from values or parsed from text."""

from .build import arrow, build, definition, exclusion, intersection, nil, permission, ref, relation, subject, union, userset, wildcard
from .dsl import parse

__all__ = ["arrow", "build", "definition", "exclusion", "intersection", "nil", "parse", "permission", "ref", "relation", "subject", "union", "userset", "wildcard"]
