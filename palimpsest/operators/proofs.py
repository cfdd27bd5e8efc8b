"""Validation of a merged-mining proof against the rules of a child chain: one Column, the first rule that fails names itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.hexbytes import MARKER, display_hash, find, le_int, meets, merkle_fold, rev, shift_left, signed32, slot, target

DEEPEST, LEGACY_AT = 30, 20


def proof_verdict(proof: Column, child_hash: Column, bits: Column, chain_id: int) -> Column:
    """Null for a valid proof (a struct as ``functions.proofs.proof`` gives), else the first violated rule. ``child_hash`` is in
    internal order."""
    depth = F.size(proof["chain_branch"])
    header, script = proof["parent_header"], proof["script"]
    parent_chain = F.shiftright(signed32(le_int(F.substring(header, 1, 8), 4)), 16)
    root = rev(merkle_fold(child_hash, proof["chain_branch"], proof["chain_position"]), 32)
    at, magic = find(script, root), find(script, F.lit(MARKER))
    again = find(F.substr(script, 2 * magic + 3), F.lit(MARKER))
    rest = F.substr(script, 2 * (at + 32) + 1)
    size, nonce = le_int(F.substring(rest, 1, 8), 4), le_int(F.substring(rest, 9, 8), 4)
    named = lambda condition, text: F.when(condition, text)
    return F.coalesce(
        named(proof.isNull() | header.isNull(), "missing proof"),
        named(depth > DEEPEST, "chain branch too long"),
        named(proof["position"] != 0, "coinbase index is not zero"),
        named(proof["chain_position"] < 0, "chain index is negative"),
        named(parent_chain == chain_id, "parent reuses the chain id"),
        named(merkle_fold(proof["txid"], proof["branch"], F.lit(0)) != F.substring(header, 73, 64), "coinbase proof mismatch"),
        named(proof["n_inputs"] == 0, "coinbase has no inputs"),
        named(at < 0, "child root missing from coinbase"),
        named((magic >= 0) & (again >= 0), "duplicate marker"),
        named((magic >= 0) & (at != magic + 4), "marker not adjacent to root"),
        named((magic < 0) & (at > LEGACY_AT), "legacy root too late"),
        named(F.length(rest) < 16, "commitment lacks size and nonce"),
        named(size != shift_left(F.lit(1).cast("bigint"), depth), "tree size mismatch"),
        named(proof["chain_position"] != slot(nonce, F.lit(chain_id), depth), "chain index mismatch"),
        named(~meets(display_hash(header), target(bits)), "parent work misses the target"),
    )
