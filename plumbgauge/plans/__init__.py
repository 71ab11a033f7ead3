"""Plan shapes shared by the operators: staging, statistics, exact quantiles, distributed ranks."""
