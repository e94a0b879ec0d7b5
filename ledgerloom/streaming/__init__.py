"""Growing a ledger from a stream of landed rows."""
