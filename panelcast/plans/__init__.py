"""Physical choices shared by the operators: ordering, attaching per-series results, sums of products."""
