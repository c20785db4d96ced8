from .plans.steps import main

main()
