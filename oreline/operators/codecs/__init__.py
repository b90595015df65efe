"""Byte codecs over independent blocks.

A codec turns bytes into bytes and back. ``REGISTRY`` names each by a number
that containers store and that is never used again for another. Blocks are
bounded, so a block is one Arrow function call's work and a table's blocks are map-only work.
"""

from oreline.operators.codecs.registry import DISABLED, REGISTRY, Codec, decode, decode_all, encode, encode_all

__all__ = ["DISABLED", "REGISTRY", "Codec", "decode", "decode_all", "encode", "encode_all"]
