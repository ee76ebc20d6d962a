"""DataFrame to DataFrame: exclude, plan, resolve, group, roll up, compare, extract."""
