from kinloom.commands import main

main()
