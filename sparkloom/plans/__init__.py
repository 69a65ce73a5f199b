"""Text filters, partial and estimated answers, and the catalogue of queries."""
