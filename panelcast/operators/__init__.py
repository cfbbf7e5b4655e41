"""Panel operators: validation, baselines, covariates, model providers, ensembles."""
