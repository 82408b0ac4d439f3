"""DataFrame to DataFrame jobs of the mobility library."""
