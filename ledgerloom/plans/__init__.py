"""Reports over the ledger: periods, statements of income and cash, VAT."""
