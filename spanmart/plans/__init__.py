"""Complete jobs built from the operators: shop marts, platform usage, job runs."""
