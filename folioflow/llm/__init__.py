"""Training-data operators: quality, chat, dedup, tokens, secrets, toxicity, leaks, fingerprints."""
