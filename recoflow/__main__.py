"""``python -m recoflow <prepare|recommend|evaluate|grid|silhouette> ...``"""

from recoflow.plans.cli import main

main()
